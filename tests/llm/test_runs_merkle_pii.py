"""Period runs, the Merkle manifest and personal data against plain versions, on odd rows and on both sides of their inner bounds."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beamquarry.llm import merkle, period_runs, pii

LONG = " ".join(f"w{i}" for i in range(60_000))


# --- runs


def plain_runs(w, least=12):
    """Every period at every place."""
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcd"), max_size=90))
def test_runs_of_few_words(w):
    assert period_runs.runs_of(w) == plain_runs(w)


def test_runs_of_planted_periods():
    rng = random.Random(4)
    for _ in range(150):
        w = []
        for _ in range(rng.randint(1, 6)):
            w += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))]
            base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 15))]
            w += (base * 7)[: rng.randint(0, 7 * len(base))]
        assert period_runs.runs_of(w) == plain_runs(w)


def test_long_texts_have_their_runs():
    tokens = [f"w{i}" for i in range(60_000)]
    assert period_runs.runs_of(tokens) == []
    assert period_runs.runs_of(tokens[:20_000] * 3) == [(0, 60_000, 20_000)]
    assert period_runs.runs_of(["a"] * 60_000) == [(0, 60_000, 1)]
    assert period_runs.runs_of(tokens[:100] + ["a", "b"] * 10_000 + tokens[:50]) == [(100, 20_000, 2)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_runs_query_on_rows(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))).replace("a", "a\t"), 5, "x") for k in range(150)]
    rows += [(900, None, 0, None), (901, "", 1, ""), (902, " \n\x0b ", 1, ""), (903, "x " * 30, 2, ""), (903, "x " * 30, 2, ""), (904, "é é " * 20, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = sorted(tuple(r) for r in period_runs.digests(period_runs.detect(period_runs.with_planted(docs))).collect())

    def expected(doc_id, text):
        w = planted(doc_id, (text or "").encode().split())
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        return (doc_id, len(runs), s, n, q, n and 1000 * n // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())

    assert got == sorted(expected(r[0], r[1]) for r in rows)
    assert sum(r[1] for r in got) > 10


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b " * 6, 1), (None, None, 2), (1, LONG, 3), (1, LONG, 3)], "doc_id long, text string, n_words int")
    out = {(r["doc_id"], r["n_words"]): [tuple(x) for x in r["runs"]] for r in period_runs.detect(docs).collect()}
    assert out == {(None, 12): [(0, 12, 2)], (None, 0): [], (1, 60_000): []}
    assert period_runs.digests(period_runs.detect(period_runs.with_planted(docs.limit(0)))).count() == 0


# --- Merkle


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(nodes):
    """(root, path of (left, right) for each node)."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, members = [], []
        for k in range(0, len(nodes), 16):
            run = nodes[k : k + 16]
            for j in range(len(run)):
                for i in groups[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(H("".join(run)))
            members.append([i for j in range(len(run)) for i in groups[k + j]])
        nodes, groups = above, members
    return nodes[0] if nodes else None, paths


def plain_manifest(rows):
    def leaf(r, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, r[4].translate(lower) if hit and r[4] is not None else r[4]), r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s])]) for s in names}
    root, tops = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (_, _, own, shown, doc_id), low in zip(sorted(by[s]), trees[s][1], strict=True):
            node = shown
            for left, right in low + top:
                node = H(left + node + right)
            out.append((doc_id, own, trees[s][0], root, H("".join(a + b for a, b in low + top)), node, node == root))
    return sorted(out, key=repr)


def merkle_rows(docs):
    audited = merkle.audit(docs, merkle.tampered(F.col("text"), F.col("doc_id")))
    out = audited.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), "folded_root", "verified").collect()
    return sorted((tuple(r) for r in out), key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, _group string, _at long, leaf int, path string"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, None: 1}, {"a": 300, "B": 257, "é": 256, "": 1, None: 40}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_of_groups(spark, sizes):
    rows = [(1000 * g + i, s, "en" if i % 7 else None, i if i % 5 else None, f"Text É {i}" if i % 11 else None, "x", 1, 2, "y") for g, (s, n) in enumerate(sizes.items()) for i in range(n)]
    random.Random(2).shuffle(rows)
    assert merkle_rows(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_manifest([r[:5] for r in rows])


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", None, None, None), (None, "a", None, None, None), (5, "a", "en", 1, LONG.upper()), (5, "a", "en", 1, "tie"), (5, "a", "en", 1, "tie"), (-3, None, "", 0, ""), (10, None, "", 0, "AÉ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle_rows(docs)
    assert got == plain_manifest(rows)
    assert merkle_rows(docs.limit(0)) == []
    repeated = docs.where("doc_id = -3").crossJoin(spark.range(2000)).drop("id")  # equal rows are dealt over the parts
    assert merkle_rows(repeated) == plain_manifest([rows[5]] * 2000)


def test_no_group_meets_in_one_task(spark):
    """Places come from parts and their counts; windows are over runs of sixteen."""
    nodes = spark.range(5000).selectExpr("'g' AS _group", "id AS _at", "5000L AS _n", "cast(id AS string) AS digest")
    levels, roots = merkle.tree(nodes)
    assert [x.count() for x in levels] == [313, 20, 2, 1]
    assert all(x.agg(F.max(F.size("_run"))).first()[0] <= 16 for x in levels)
    assert roots.first()["digest"] == plain_tree([str(i) for i in range(5000)])[0]


def test_a_changed_row_is_found_and_no_other(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", 1, f"t{i}") for i in range(200)], SCHEMA.split(", _group")[0])
    shown = F.when(F.col("doc_id") == 77, merkle.leaf(text=F.lit("other"))).otherwise(merkle.leaf())
    assert [r["doc_id"] for r in merkle.audit(docs, shown).where("NOT verified").collect()] == [77]


# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    figures = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 10 <= len(figures) <= 15
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(figures))]
        return 14 <= len(figures) <= 19 and sum(doubled) % 10 == 0
    return True


def plain_base(text):
    return sorted((m.start(), pii.KINDS.index(k), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m.group()))


PIECES = [
    "a@b.c", "x.y+z@mail-1.example.com", "a@b", "@c.d", "a@b.c@d.e", "a@b.c_d@e.f.", "é@é.fr", "1.2.3.4", "1.2.3.256", "1.2.3.4.5.6.7.8", "01.002.0003.255", "..", "4111 1111 1111 1111",
    "4111-1111-1111-1111", "4111111111111111", "4111111111111112", "9", "+1 (499) 555-6503", "+49 30.1234-5678", "+1", "+12 ", "-", "é中\U0001f600", "\n", " ", "12345678901234567890", "word", "Z%", "+",
]


def test_spans_of_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, i, "b") for i, t in enumerate(texts)], "doc_id long, text string, start int, base string")
    for r in pii.find(docs).collect():
        assert [tuple(s)[:4] for s in r["base"]] == plain_base(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[3] == k for s in plain_base(texts[r["doc_id"]])) for k in pii.KINDS]


def test_texts_of_any_length_are_read_once(spark):
    """Long runs of one class, as many places as a text can hold, and more than a block of them."""
    texts = ["a" * 300_000, "@" + "a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 200_000, "a@" + "b." * 100_000 + "c", "x@y.z " * 3000, "1.2.3.4 " * 700, LONG + " a@b.c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s)[:4] for s in r["base"]] for r in pii.find(docs).collect()}
    assert len(got[6]) == 3000 and got[6][2999][:3] == (6 * 2999, 0, 6 * 2999 + 5)
    assert len(got[7]) == 700 and got[7][699][0] == 8 * 699
    assert got[8] == [(len(LONG) + 1, 0, len(LONG) + 6, "email")]
    assert got[5] == [(0, 0, len(texts[5]), "email")]
    assert got[0] == got[1] == got[2] == got[4] == []


def test_sums_in_blocks(spark):
    lengths = [random.Random(n).choices(range(50), k=n) for n in (0, 1, 255, 256, 257, 1000)]
    got = spark.createDataFrame([(x,) for x in lengths], "x array<int>").select(pii.running(F.col("x"))).collect()
    assert [r[0] for r in got] == [[sum(x[: i + 1]) for i in range(len(x))] for x in lengths]


def corpus():
    """An address that a nickname always goes with, in different company, and words that are everywhere."""
    rng = random.Random(8)
    common_words = ["the", "of", "and", "from", "with", "this", "that", "north", "south", "paper", "stone", "river"]
    rows = [(i, " ".join(rng.choices(common_words, k=20))) for i in range(200)]
    for i in range(200, 206):
        left, right = (" ".join(rng.choices(common_words, k=6)) for _ in range(2))
        rows.append((i, f"Zorblax paper. {left} Zorblax jane@corp.example {right} and the zorblax river"))
    rows += [(300, "Only once unusual@corp.example with Quibber"), (301, "no entity but Zorblax? none"), (302, None), (303, ""), (303, "")]
    return rows


def test_disclosing_terms_go_where_their_entity_is(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, spans int, terms string")
    out = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    for i in range(200, 206):
        text = dict(rows)[i]
        marked = [text[s["start"] : s["end"]].lower() for s in out[i]["spans"] if s["kind"] == "term"]
        assert marked == ["zorblax"] * 3
        assert "zorblax" not in out[i]["clean_text"].lower() and "<email>" in out[i]["clean_text"] and "jane" not in out[i]["clean_text"]
    assert [s["kind"] for s in out[300]["spans"]] == ["email"]  # one context proves nothing
    assert out[301]["spans"] == [] and out[301]["clean_text"] == "no entity but Zorblax? none"
    assert out[302]["clean_text"] is None and out[303]["clean_text"] == ""
    assert all(out[i]["spans"] == [] and out[i]["clean_text"] == t for i, t in rows[:200])


def test_shares_of_information(spark):
    """In six of seven documents with the term its entity is there: it discloses 1 + log2(6/7) / log2(N/6) of it."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = pii.contexts(docs)
    total = docs.count()
    risky = {(r["e"], r["t"]): r["share"] for r in pii.risks(found, docs, total).collect()}
    import math

    assert set(risky) == {("email:jane@corp.example", "zorblax")}
    assert risky["email:jane@corp.example", "zorblax"] == pytest.approx(1 + math.log2(6 / 7) / math.log2(total / 6))


def test_personal_data_of_odd_rows(spark):
    rows = [(None, "a@b.c"), (None, "a@b.c"), (None, None), (1, "x " + LONG + " +1 (499) 555-6503"), (1, "tie 1.2.3.4"), (1, "tie 1.2.3.4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["spans"]) for r in pii.digests(pii.sanitise(docs)).collect()), key=repr)
    n = len(LONG) + 3
    assert got == sorted([(None, "email:0:5"), (None, "email:0:5"), (None, ""), (1, f"phone:{n}:{n + 17}"), (1, "ip:4:11"), (1, "ip:4:11")], key=repr)
    assert pii.digests(pii.sanitise(docs.limit(0))).count() == 0


@pytest.mark.parametrize("name", ["op11_period_runs", "op12_merkle_manifest", "op13_pii"])
def test_query_equals_sql(spark, sf_dir, name):
    import duckdb

    from beamquarry.llm import queries

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    rows = got.select(*want.columns).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, want.fetchall()), key=repr) and len(rows) > 100
