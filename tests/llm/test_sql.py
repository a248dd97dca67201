"""SQL of the corpus queries on odd texts and generated ones."""

import random

import duckdb
import pyarrow as pa
import pytest

from tidemark.llm.oracles import ORACLE_SQL
from tidemark.llm.secrets import scan_secrets
from tidemark.llm.suffix_dedup import count_repeats

from .conftest import ODD


def parted(rnd):
    """A text of whole, weak and short parts at all distances."""
    makes = [
        lambda: f"user={rnd.choice(['bob.k', 'al', 'key-9x'])}",
        lambda: "AKIA" + "".join(rnd.choices("ABC123", k=rnd.choice([12, 16, 18]))),
        lambda: "AXIA" + "".join(rnd.choices("AB12", k=rnd.choice([3, 16]))),
        lambda: f"Api_Key: '{rnd.choice(['abcdef', 'abc', 'a/b+c9='])}'",
        lambda: "".join(rnd.choices("0123abcdef", k=rnd.choice([10, 24, 40]))),
        lambda: "".join(rnd.choices("abcXYZ019+/_-", k=rnd.choice([31, 32, 44]))) + "==",
        lambda: f"https://{rnd.choice(['x.io/a', 'abc', 'db.example.org:99'])}",
        lambda: "é漢 " * rnd.choice([1, 5, 199, 200, 201]),
    ]
    return rnd.choice([" ", "\n", ", "]).join(rnd.choice(makes)() for _ in range(rnd.randrange(12)))


def passages(rnd, n):
    shared = ["".join(rnd.choices("abcdé漢 ", k=k)) for k in (150, 199, 230, 400, 1300)]
    return ["".join(rnd.choice(shared) if rnd.random() < 0.4 else "".join(rnd.choices("xyz ü", k=rnd.randrange(120))) for _ in range(rnd.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("query, name", [(scan_secrets, "op6_secret_scan"), (count_repeats, "op10_suffix_dedup")])
def test_sql_agrees(spark, docs, query, name):
    rnd = random.Random(11)
    rows = ODD + [(100 + k, parted(rnd)) for k in range(60)] + [(200 + k, t) for k, t in enumerate(passages(rnd, 40))]
    con = duckdb.connect()
    ids, texts = zip(*rows)
    con.register("documents", pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}))
    sql = con.sql(ORACLE_SQL[name])
    found = query(docs(rows)).select(*sql.columns)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, sql.fetchall()))
    assert con.sql(ORACLE_SQL[name].replace("FROM documents", "FROM documents WHERE false")).fetchall() == []
