"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from lociform.plans.catalog import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def told(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(tuple(told(r[c]) for c in names) for r in df.collect())
    found = duck.execute(SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == names
    at = [theirs.index(c) for c in names]
    assert got == sorted(tuple(told(r[i]) for i in at) for r in found.fetchall())


def student_tail(t, df, steps=4_000):
    """Two-sided p of Student's t by Simpson's rule over the angle; its root to the power of 1/4 keeps the end smooth for a small df."""
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    top = (math.pi / 2 - math.atan(abs(t) / math.sqrt(df))) ** 0.25
    h = top / steps
    each = lambda u: math.sin(u**4) ** (df - 1) * 4 * u**3
    total = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * (each(i * h) if i else 0.0) for i in range(steps + 1))
    return 2 * front * total * h / 3


def test_t_test_p(spark):
    rows = QUERIES["t_test_p"](spark, DIR).collect()
    assert rows
    for r in rows:
        for kind in ("pooled", "welch"):
            assert r[f"p_{kind}"] == pytest.approx(student_tail(r[f"t_{kind}"], r[f"df_{kind}"]), abs=1e-6)


def two_sided(a, b, c, d):
    lf = lambda n: math.lgamma(n + 1)
    w = lambda k: math.exp(lf(a + b) + lf(c + d) + lf(a + c) + lf(b + d) - lf(a + b + c + d) - lf(k) - lf(a + b - k) - lf(a + c - k) - lf(d - a + k))
    return sum(x for k in range(max(0, a - d), min(a + b, a + c) + 1) if (x := w(k)) <= w(a) * (1 + 1e-7))


def test_differing_regions(spark):
    """Stretches between gaps, thirds of what differs not enough."""
    sites = {}
    for r in spark.read.parquet(f"{DIR}/lineitem.parquet").collect():
        cell = (2 if r["l_returnflag"] == "N" else 0) + (r["l_linenumber"] % 4 != 0)
        sites.setdefault(r["l_partkey"], [0, 0, 0, 0])[cell] += 1
    pos = sorted(sites)
    cuts = [i for i in range(len(pos)) if i == 0 or pos[i] - pos[i - 1] > 1000] + [len(pos)]
    want, todo = set(), list(zip(cuts, cuts[1:], strict=False))
    while todo:
        a, z = todo.pop()
        if z - a < 3:
            continue
        p = two_sided(*(sum(sites[x][k] for x in pos[a:z]) for k in range(4)))
        if p <= 0.05:
            want.add((pos[a], pos[z - 1] + 1, z - a, round(p, 6)))
        elif third := (z - a) // 3:
            todo += [(a, a + third), (a + third, a + 2 * third), (a + 2 * third, z)]
    got = QUERIES["differing_regions"](spark, DIR).collect()
    assert {(r["start"], r["end"], r["sites"], round(r["p"], 6)) for r in got} == want and want


def test_equivalent_indels(spark):
    """Placing the indel anywhere in the range gives the same sequence, and nowhere beside it."""
    rows = QUERIES["equivalent_indels"](spark, DIR).collect()
    assert rows
    for r in rows:
        g, made = r["genome"], r["genome"][: r["start"]] + r["inserted"] + r["genome"][r["start"] + len(r["deleted"]) :]
        n = len(r["deleted"] or r["inserted"])
        if r["deleted"]:
            same = [i for i in range(len(g) - n + 1) if g[:i] + g[i + n :] == made]
            assert (min(same), max(same) + n) == (r["eir_start"], r["eir_end"])
        else:
            same = [i for i in range(len(g) + 1) if g[:i] + made[i : i + n] + g[i:] == made]
            assert (min(same), max(same)) == (r["eir_start"], r["eir_end"])


def test_queries_without_sql_are_tested():
    assert set(QUERIES) - set(SQL) == {"t_test_p", "differing_regions", "equivalent_indels"}
