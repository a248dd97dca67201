"""SimHash fingerprints of documents and a search for all of them within a Hamming radius, by DataFrame functions alone.

Terms are shingles of five words (a shorter text is one shingle); each occurrence votes, so a term
weighs as often as it comes. The 64 votes of a term are added as 32 numbers of two 32-bit fields.
The search keeps, for radius r, one table for each way to choose r of 2r blocks of bits: two
fingerprints that differ in at most r bits agree in all blocks of at least one choice.

Defined results: a null text counts as empty; texts without words share one fingerprint; equal
texts have equal fingerprints; of rows with one id, those with smaller texts come first; null ids
come before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

WORDS = 5
FIELDS = 0x0000000100000001
FIRST = -(2**63)


def term_hashes(text: Column) -> Column:
    """The words of a text and its next ones, as structs to explode; incomplete ones (but the first) have no last word."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    shifted = [words] + [F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))) for k in range(1, WORDS)]
    return F.when(F.size(words) > 0, F.arrays_zip(*(x.alias(f"w{k}") for k, x in enumerate(shifted)))).otherwise(F.array(F.struct(*(F.lit(None).cast("string").alias(f"w{k}") for k in range(WORDS)))))


def voted(rows: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """The fingerprint (a long) of the text of each row; ``keys`` name each row by itself."""
    terms = rows.select(*keys, F.posexplode(term_hashes(F.col(text))).alias("_pos", "_t"))
    terms = terms.where((F.col("_pos") == 0) | F.col(f"_t.w{WORDS - 1}").isNotNull()).select(*keys, F.xxhash64(*(F.col(f"_t.w{k}") for k in range(WORDS))).alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(FIELDS))).alias(f"_s{k}") for k in range(32)]
    votes = terms.groupBy(*keys).agg(F.count(F.lit(1)).alias("_terms"), *sums)
    bits = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{k}", 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("_terms"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        top = 1 << (k + 32)
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("_terms"), F.lit(top - (1 << 64) if top >= 1 << 63 else top).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, bits.alias(out))


def shown(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _blocks(docs: DataFrame, key: Column, per_block: int, most: int) -> Column:
    """The number of the block of ids that a key falls into; blocks follow each other in the order of keys and hold about as many rows."""
    many = min(most, max(1, -(-docs.count() // per_block)))
    cuts = []
    if many > 1:
        shares = [k / many for k in range(1, many)]
        cuts = sorted(set(docs.agg(F.percentile_approx(key, shares, 100_000).alias("c")).first()["c"]))
    groups = [cuts[k : k + 64] for k in range(0, len(cuts), 64)] or [[]]
    heads = F.array(*(F.lit(g[0]).cast("long") for g in groups if g)) if cuts else F.array().cast("array<long>")
    table = F.array(*(F.array(*(F.lit(c).cast("long") for c in g)) if g else F.array().cast("array<long>") for g in groups))
    group = F.greatest(F.size(F.filter(heads, lambda c: c <= key)), F.lit(1))
    return ((group - 1) * 64 + F.size(F.filter(F.element_at(table, group), lambda c: c <= key))).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_block: int = 4096, most_blocks: int = 4096) -> DataFrame:
    """Rows in order of id, each with the text of the next one (of the last: the first).

    The order is kept in blocks of neighbouring ids. Each block ends with a copy of the first row
    of the next block (``_copy`` is 1), so each block is worked on alone. Columns: id, text,
    _block, _copy, _n (place in the block), next_text.
    """
    plain = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("_key"))
    block = _blocks(plain, F.col("_key"), per_block, most_blocks)
    rows = plain.withColumn("_block", block)
    least = rows.groupBy("_block").agg(F.min("_key").alias("_key"))  # at most `most_blocks` rows
    firsts = rows.join(F.broadcast(least), ["_block", "_key"]).groupBy("_block").agg(F.min("text").alias("text"))
    ring = Window.orderBy("_block")  # one row per block
    last = F.max("_block").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    goes_to = F.coalesce(F.lag("_block").over(ring), last)  # the first block's copy ends the last one
    copies = firsts.select(F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), "text", F.lit(None).cast("long").alias("_key"), goes_to.alias("_block"), F.lit(1).alias("_copy"))
    order = Window.partitionBy("_block").orderBy("_copy", "_key", "text")
    return rows.withColumn("_copy", F.lit(0)).unionByName(copies).withColumn("_n", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).drop("_key")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_block: int = 4096) -> DataFrame:
    """Each row's fingerprint, that of its edited text (the last half replaced by the next text's start) and how like they are."""
    rows = with_next(docs, id_col, text_col, per_block)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.when(half >= 0, edited)).withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    texts = F.when(F.col("_copy") == 0, F.array("text", "_edited")).otherwise(F.array("text"))
    keys = ["_block", "_copy", "_n", id_col, "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.posexplode(texts).alias("_which", "_text"))
    each = voted(both, [*keys, "_which"], "_text", "_f").repartition("_block")
    own = each.groupBy(*keys).agg(F.max(F.when(F.col("_which") == 0, F.col("_f"))).alias("_own"), F.max(F.when(F.col("_which") == 1, F.col("_f"))).alias("_new"))
    order = Window.partitionBy("_block").orderBy("_n")
    own = own.withColumn("_next", F.lead("_own").over(order)).where("_copy = 0")
    return own.select(id_col, "n_chars", "edited_sha256", shown("_own").alias("fingerprint"), shown("_new").alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"), F.col("_own").alias("fingerprint_bits"))


def block_tables(rows: DataFrame, bits: str, radius: int) -> DataFrame:
    """``rows`` once for each table, with the table's number and the bits of its chosen blocks."""
    count = 2 * radius
    edges = [64 * k // count for k in range(count + 1)]
    masks = []
    for chosen in combinations(range(count), count - radius):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    keys = F.array(*(F.col(bits).bitwiseAND(F.lit(m).cast("long")) for m in masks))
    return rows.select("*", F.posexplode(keys).alias("_table", "_key"))


def within_radius(queries: DataFrame, rows: DataFrame, bits: str = "fingerprint_bits", radius: int = 3) -> DataFrame:
    """For each distinct fingerprint of ``queries``: n_within, the rows whose fingerprints differ in at most ``radius`` bits, itself included.

    Equal fingerprints are counted together first, so copies meet once.
    """
    distinct = rows.groupBy(F.col(bits).alias("_other")).agg(F.count(F.lit(1)).alias("_rows"))
    asked = block_tables(queries.select(bits).distinct(), bits, radius)
    held = block_tables(distinct, "_other", radius)
    near = asked.join(held, ["_table", "_key"]).where(F.bit_count(F.col(bits).bitwiseXOR(F.col("_other"))) <= radius)
    return near.groupBy(bits, "_other").agg(F.max("_rows").alias("_rows")).groupBy(bits).agg(F.sum("_rows").alias("n_within"))
