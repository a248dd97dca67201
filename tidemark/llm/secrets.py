"""Secret scan with multipart credential linking, by DataFrame functions alone.

Three kinds of spans stand on their own: assignments of a secret word, access ids and long hex
runs. Weak parts (names of an account, other long mixed strings, endpoints) mean little alone; a
weak part is reported only if other parts complete it: an identifier needs a secret, a secret an
identifier, an endpoint one of each. A part that completes another doesn't overlap it, lies at most
``scope`` code points before its start or behind its end, and isn't the same value come again;
identifiers and secrets that overlap each other count as one value. The intervals are joined by
range frames over the ends of each text's parts, so no pairs are made.

Each text is scanned where it is read; only the found parts (and one row per document) are
shuffled. Defined results: a null text counts as empty; a null id stays null; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Base kinds in their order: pattern, group whose length counts, least length. Fixed values.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)" + VALUE + r"([A-Za-z0-9+/_.=-]+)", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Weak kinds: pattern, group whose length counts, least length.
WEAK = {
    "weak_id": (r"(?:\b(?i:access_?key_?id|access_?key|client_?id|account|login|username|user)" + VALUE + r"|\bA[A-Z]IA)([A-Za-z0-9@+/_.-]+)", 1, 4),
    "weak_secret": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{32})(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])([A-Za-z0-9+/_-]{32,})=*", 1, 32),
    "weak_endpoint": (r"(?:(?i:https?|postgres|postgresql|mysql|redis|mongodb|amqp|s3)://|\b(?i:host|endpoint|server)" + VALUE + r""")([^\s"'<>,;]+)""", 1, 4),
}
KINDS = {**BASE, **WEAK}
ROLES = {"identifier": ("access", "weak_id"), "secret": ("assign", "hex", "weak_secret"), "endpoint": ("weak_endpoint",)}
SCOPE = 400


def _found(text: Column, kind: str) -> Column:
    """All matches of a kind as (kind number, place, code points before it since the last match, its own, kept or not, hash of its value)."""
    pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("all"), counted.alias("part"))
    number = list(KINDS).index(kind)
    rows = F.transform(
        F.filter(zipped, lambda x: x["all"].isNotNull()),
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["all"]).alias("size"), (F.length(x["part"]) >= least).alias("kept"), F.xxhash64(x["part"]).alias("value")),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), rows).otherwise(F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,kept:boolean,value:bigint>>"))


def secret_parts(rows: DataFrame, key: str, carry: list[str], text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per reported span of each text: ``key``, ``carry``, kind (number in KINDS), start, end; texts without any have one row of nulls.

    ``key`` names each row of ``rows`` by itself; it is computed in the scan that finds the parts.
    """
    text = text_or_empty(text_col)
    found = rows.select(key, *carry, F.explode_outer(F.concat(*(_found(text, k) for k in KINDS))).alias("x")).select(key, *carry, "x.*")
    placed = found.repartition(key)
    ends = Window.partitionBy(key, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(ends)).withColumn("start", F.col("end") - F.col("size"))
    # parts that are too short leave a row without a span, so that no document is lost
    placed = placed.withColumn("kind", F.when(F.col("kept"), F.col("kind")))
    numbers = {k: i for i, k in enumerate(KINDS)}
    of_role = {r: F.col("kind").isin([numbers[k] for k in kinds]) for r, kinds in ROLES.items()}
    before = Window.partitionBy(key).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("kind") < len(BASE)
    # identifiers and secrets that overlap get the value of the first of them
    valued = of_role["identifier"] | of_role["secret"]
    reach = F.max(F.when(valued, F.col("end"))).over(before.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("_covered", F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1)) > F.col("start"))
    placed = placed.withColumn("_new", F.when(valued & (reach.isNull() | (F.col("start") >= reach)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(before))
    same = Window.partitionBy(key, "_run").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(valued, F.col("value")), ignorenulls=True).over(same)
    placed = placed.withColumn("value", F.when(valued, first).otherwise(F.col("value")))
    # each part is found by its end from what follows it and by its start from what it follows, and asks at its start and at its end
    found_end, asks_back, found_start, asks_on = range(4)
    events = F.array(*(F.struct(F.col(at).alias("at"), F.lit(what).alias("what")) for at, what in (("end", found_end), ("start", asks_back), ("start", found_start), ("end", asks_on))))
    events = F.when(F.col("kind").isNotNull(), events).otherwise(F.slice(events, 1, 1))
    met = placed.withColumn("_e", F.explode(events)).withColumn("_at", F.col("_e.at")).withColumn("_what", F.col("_e.what")).drop("_e")
    around = {asks_back: (found_end, Window.partitionBy(key).orderBy("_at").rangeBetween(-scope, 0)), asks_on: (found_start, Window.partitionBy(key).orderBy("_at").rangeBetween(0, scope))}
    ends = {"low": F.min, "high": F.max}
    for asks, (found, frame) in around.items():
        for r in ("identifier", "secret"):
            for n, f in ends.items():
                met = met.withColumn(f"_{r}_{n}_{asks}", f(F.when((F.col("_what") == found) & of_role[r], F.col("value"))).over(frame))
    told = [f(F.when(F.col("_what") == asks_back, F.col(f"_{r}_{n}_{asks_back}")).when(F.col("_what") == asks_on, F.col(f"_{r}_{n}_{asks_on}"))).alias(f"_{r}_{n}") for r in ("identifier", "secret") for n, f in ends.items()]
    parts = met.groupBy(key, *carry, "kind", "start", "end", "value", "_covered").agg(*told)
    # of all values around, the least or the highest is another one than its own if any is
    another = {r: F.coalesce(F.col(f"_{r}_low") != F.col("value"), F.lit(False)) | F.coalesce(F.col(f"_{r}_high") != F.col("value"), F.lit(False)) for r in ("identifier", "secret")}
    two = F.least("_identifier_low", "_secret_low") != F.greatest("_identifier_high", "_secret_high")
    complete = F.when(F.col("kind") == numbers["weak_id"], another["secret"]).when(F.col("kind") == numbers["weak_secret"], another["identifier"]).otherwise(another["identifier"] & another["secret"] & two)
    reported = F.col("kind").isNull() | base | (~F.col("_covered") & complete)
    # weak parts that aren't reported leave a row without a span too
    return parts.select(key, *carry, F.when(reported, F.col("kind")).alias("kind"), F.when(reported, F.col("start")).alias("start"), F.when(reported, F.col("end")).alias("end"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: its id, the number of spans of each base kind, a digest of the base spans and all spans as text."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).withColumn("_row", F.monotonically_increasing_id())
    parts = secret_parts(rows, "_row", [id_col], "text", scope)
    spans = F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))))
    per = parts.groupBy("_row", id_col).agg(spans.alias("all"))
    base = F.filter("all", lambda x: x["kind"] < len(BASE))

    def of_kind(number: int) -> Column:
        return F.size(F.filter("all", lambda x: x["kind"] == number)).cast("long")

    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return per.select(id_col, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans are replaced together. Other columns stay.

    The table is written once with a mark on each row whose text has any part, so that texts are
    scanned once for that; only those rows are dealt out.
    """
    text = text_or_empty(text_col)
    any_part = F.lit(False)
    for pattern, _, _ in KINDS.values():
        any_part = any_part | F.regexp_like(text, F.lit(pattern))
    rows = written(docs.withColumn("_tm_any", any_part), "scanned")
    touched = written(rows.where("_tm_any"), "touched").withColumn("_tm_row", F.monotonically_increasing_id())
    parts = secret_parts(touched.select("_tm_row", F.col(text_col).alias("text")), "_tm_row", [], "text", scope).where(F.col("kind").isNotNull())
    reach = Window.partitionBy("_tm_row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    runs = Window.partitionBy("_tm_row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    merged = parts.withColumn("_tm_new", (F.coalesce(F.max("end").over(reach), F.lit(-1)) <= F.col("start")).cast("int")).withColumn("_tm_run", F.sum("_tm_new").over(runs))
    merged = merged.groupBy("_tm_row", "_tm_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy("_tm_row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_tm_cuts"))
    # what is kept lies before each cut, from the end of the one before it, and after the last
    kept = F.concat(
        F.transform("_tm_cuts", lambda x, i: F.substring(F.col(text_col), F.when(i > 0, F.get("_tm_cuts", i - 1)["end"]).otherwise(0).cast("int") + 1, (x["start"] - F.when(i > 0, F.get("_tm_cuts", i - 1)["end"]).otherwise(0)).cast("int"))),
        F.array(F.substring(F.col(text_col), (F.element_at("_tm_cuts", -1)["end"] + 1).cast("int"), F.length(text_col))),
    )
    cut = touched.join(cuts, "_tm_row", "left").withColumn(text_col, F.when(F.col("_tm_cuts").isNotNull(), F.array_join(kept, mark)).otherwise(F.col(text_col)))
    return rows.where(~F.col("_tm_any")).select(*docs.columns).unionByName(cut.select(*docs.columns))
