"""Every query with SQL against DuckDB, row by row; the others must run and give the columns they promise."""

from decimal import Decimal

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]
WITH_SQL = [q for q in OWN if q in entry.oracle_sql()]


def value(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(value(x) for x in v)
    if isinstance(v, (float, np.floating, Decimal)):
        return None if v != v else round(float(v), 7) + 0.0
    return v.item() if isinstance(v, np.generic) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", WITH_SQL)
def test_equals_sql(spark, duck, data, name):
    got, want = entry.queries()[name](spark, data), duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    left = sorted((tuple(value(r[c]) for c in columns) for r in got.collect()), key=repr)
    right = sorted((tuple(value(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", ["f09_snowball", "f25_name_rules"])
def test_rows_only(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_fuzzy_names_by_brute_force(spark, data, duck):
    """Each slot's strictest rule over all names there are."""
    from namewright.functions.names import rule_number

    got = {r["slot"]: (r["rule"], r["name"]) for r in entry.queries()["j03_fuzzy_names"](spark, data).collect()}
    all_names = [r[0] for r in duck.sql("select distinct p_name from part").fetchall()]
    assert len(got) > 20
    for slot, best in got.items():
        assert best == min((k, n) for n in all_names if (k := rule_number(slot, n)))


def test_author_lists_by_brute_force(spark, data, duck):
    from namewright.functions.names import rule_number

    got = {(r["pid"], r["aid"]): r["matched"] for r in entry.queries()["j15_author_lists"](spark, data).collect()}
    new = {}
    order = "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) > count(*) over (partition by o_custkey) - floor(count(*) over (partition by o_custkey) * 0.2)"
    split = duck.sql(f"select o_orderkey, o_custkey, {order} from orders").fetchall()
    named = {}
    for pid, line, name in duck.sql("select l_orderkey, l_linenumber, p_name from lineitem join part on l_partkey = p_partkey").fetchall():
        named.setdefault(pid, []).append((line, name))
    older = {}
    for pid, aid, is_new in split:
        if is_new:
            new[pid, aid] = {f"{n[0]} {n.split()[-1]}" if line % 2 == 0 else n for line, n in named.get(pid, [])}
        else:
            older.setdefault(aid, set()).update(n for _, n in named.get(pid, []))
    assert len(got) == len(new) and max(got.values()) > 1
    rules = {}
    for (pid, aid), mine in new.items():
        theirs = older.get(aid, set())
        assert got[pid, aid] == sum(any(rules.setdefault((a, b), rule_number(a, b)) for a in mine) for b in theirs)


def test_spectral_products(spark, data):
    """The vectors' products are those of U S U' of each person's matrix, rows of unit length."""
    from namewright.operators import graph
    from namewright.plans.pairs import person_edges

    got = entry.queries()["g09_spectral"](spark, data).collect()
    edges = graph.symmetric(person_edges(spark, data), ["aid"]).collect()
    persons = sorted({r["aid"] for r in got})
    assert persons == sorted({r["aid"] for r in edges})
    for person in persons[:25]:
        mine = {r["node"]: np.array(r["vec"]) for r in got if r["aid"] == person}
        nodes = sorted(mine)
        m = np.zeros((len(nodes), len(nodes)))
        for r in edges:
            if r["aid"] == person:
                m[nodes.index(r["a"]), nodes.index(r["b"])] = r["w"]
        value, vector = np.linalg.eigh(m)
        want = vector * np.sqrt(np.abs(value))
        want /= np.linalg.norm(want, axis=1, keepdims=True)
        have = np.stack([mine[n] for n in nodes])
        assert len(nodes) <= 100 and np.allclose(have @ have.T, want @ want.T, atol=1e-6)


@pytest.mark.parametrize("name", ["m01_gbt", "m02_stack", "m02_cells", "m03_mlp", "m04_logistic"])
def test_scorers_score_every_held_out_pair(spark, data, name):
    """The tables' persons are drawn at random, so quality is measured on a planted fixture (test_functions)."""
    got = entry.queries()[name](spark, data).collect()
    score = got[0].__fields__[-1]
    assert len({(r["pid"], r["aid"]) for r in got}) == len(got) > 50 and {r["pid"] % 5 for r in got} == {0}
    assert all(0 <= r[score] <= 1 for r in got) and len({r[score] for r in got}) > 5


@pytest.mark.parametrize("name,column,dims", [("g06_word2vec", "vec", 16), ("g08_text_vectors", "latent", 64)])
def test_text_vectors(spark, data, duck, name, column, dims):
    """A vector a document; documents of one language are nearer to each other than to others."""
    got = {r["doc_id"]: np.array(r[column]) for r in entry.queries()[name](spark, data).collect()}
    lang = dict(duck.sql("select doc_id, lang from documents").fetchall())
    assert len(got) >= 0.9 * len(lang) and all(len(v) == dims for v in got.values())
    centre = np.mean(list(got.values()), axis=0)
    ids = [k for k in sorted(got) if np.linalg.norm(got[k] - centre) > 0 and lang.get(k)]
    unit = np.stack([(got[k] - centre) / np.linalg.norm(got[k] - centre) for k in ids])
    same = np.array([[lang[a] == lang[b] for a in ids] for b in ids])
    product = unit @ unit.T
    assert product[same].mean() > product[~same].mean()


@pytest.mark.parametrize("name", ["g01_walk", "g02_walk_extra", "g03_biased_walk"])
def test_walk_queries_follow_relations(spark, data, duck, name):
    """Walks of all papers; each hop is over a co-author, organisation, venue or word in common."""
    got = entry.queries()[name](spark, data).collect()
    n = duck.sql("select count(*) from orders").fetchall()[0][0]
    assert len(got) == n * (5 if name == "g01_walk" else 1) and max(len(r["path"]) for r in got) > 5
    line = duck.sql("select l_orderkey, l_suppkey, s_nationkey, o_orderpriority, p_name from lineitem join supplier on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey").fetchall()
    tokens = {pid: {("v", venue)} for pid, venue in duck.sql("select o_orderkey, o_orderpriority from orders").fetchall()}
    for pid, author, org, _, name_ in line:
        tokens[pid].update({("a", author), ("o", org), *(("w", w) for w in name_.split())})
    for r in got[:: max(1, len(got) // 300)]:
        assert r["path"][0] == r["start"]
        assert all(a != b and tokens[a] & tokens[b] for a, b in zip(r["path"], r["path"][1:]))


def test_entry(spark):
    assert entry.entry(spark).columns == ["pid", "aid", "score"]
