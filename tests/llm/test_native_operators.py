"""Operators 1, 2, 5, 6 and 8 against brute force and odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from beamquarry.llm import chat, exact_dedup, mixing, quality, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _words string, size int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "a b c a b c\n\nend of it.", "en", "s1", 5, "x", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s2", 0, None, 2),
        (4, " \t\x0b ", "en", "s2", 3, "y", 3),
        (5, "word. " * 400, "en", "s1", 9, "z", 4),
        (6, "a b c a b c\n\nend of it.", "de", "s3", 5, "x", 5),
        (7, "ünï\u00a0cödé 日本 # $ same line.\nsame line.\nsame line.\n", "de", None, 5, "x", 6),
        (8, " ".join(f"w{i}" for i in range(3000)) + ".", "en", "s9", 1, None, 7),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def targets(sizes, weights=(5, 2, 1), times=3):
    """Share out, hold at the cap, share the excess again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        got = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if got[s] > times * sizes[s] or sizes[s] == 0]
        if not over:
            return held | got
        held |= {s: times * sizes[s] for s in over}


@pytest.mark.parametrize("which", ["docs", "corpus"])
def test_mixing_meets_targets(which, request):
    df = request.getfixturevalue(which)
    out = rows_of(mixing.mix(df))
    rows = df.collect()
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += size[r["doc_id"]]
    want, taken = targets(by), defaultdict(int)
    for r in rows:
        got = out[r["doc_id"]]
        assert (got["size"], got["source_size"]) == (size[r["doc_id"]], by[r["source"]])
        assert got["target"] == pytest.approx(want[r["source"]])
        assert 0 <= got["taken"] <= 3 * got["size"]
        taken[r["source"]] += got["taken"]
    for s in by:
        assert abs(taken[s] - want[s]) <= 8
    assert out == rows_of(mixing.mix(df))


def test_sainte_lague_is_the_highest_quotients(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0, "e": 7}
    df = spark.createDataFrame([(k, float(v), n) for k, v in votes.items() for n in [41]], "k string, w double, n long")
    got = {r["k"]: r["q"] for r in mixing.sainte_lague(df, [], "k", "w", "n", "q").collect()}
    best = sorted(((v / (2 * i + 1), k) for k, v in votes.items() for i in range(60)), reverse=True)[:41]
    assert got == {k: Counter(x for _, x in best).get(k, 0) for k in votes}


def test_applied_mix_keeps_text(docs):
    taken = mixing.mix(docs)
    out = mixing.apply_mix(docs, taken)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {k: v for k, v in words.items() if v} == {r["doc_id"]: r["taken"] for r in taken.collect() if r["taken"]}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("which", ["docs", "corpus"])
def test_exact_dedup(which, keep, request):
    df = request.getfixturevalue(which)
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    pick = max if keep == "largest" else min
    want = {}
    for text, ids in groups.items():
        for i in ids:
            want[i] = {"doc_id": i, "keep_id": pick(ids), "group_size": len(ids), "kept": i == pick(ids), "text_sha256": hashlib.sha256(text.encode()).hexdigest()}
    assert rows_of(exact_dedup.dedup(df, keep)) == want
    assert rows_of(exact_dedup.by_bytes(df, keep)) == want


def turns_of(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "system", "be \\ good"), (1, 1, "user", "a\\<|b"), (1, 2, "assistant", "<\\|x\\\\|\n"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
        (2, 0, "user", "only"), (3, 0, "assistant", odd), (4, 1, None, "x"), (4, 0, "we\nird<|im_start|>", "<\\/>\\"), (4, 2, "assistant", "日本 <|im_end|>\n"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


@pytest.mark.parametrize("which", ["odd", "corpus"])
def test_chat_round_trip(spark, sf_dir, which):
    df = chat.with_planted(turns_of(spark) if which == "odd" else spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    convs = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["turn"]):
        convs[r["conv_id"]].append((r["role"] or "", r["text"] or ""))
    examples = chat.prefix_targets(df)
    got = rows_of(chat.digests(examples), "conv_id")
    assert set(got) == set(convs)
    for k, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    by = defaultdict(int)
    for e in examples.collect():
        by[e["conv_id"]] += e["loss_end"] > e["loss_start"]
        assert e["formatted"].count(chat.START) == e["n_turns"]
    assert all(by[k] == sum(r == "assistant" and t != "" for r, t in turns) for k, turns in convs.items())


def test_url_rules_and_cascade(spark):
    urls = [
        None, "", "no scheme", "http://Example.COM/en/7x?y", "https://a.example.com/en/8", "x://example.net/de/8", "x://net/de/1", "x://b.net/de/", "x://c.org/es/#f",
        "http://www.free-bets.example.com", "http://xfree-bets.example.com/fr", "http://spam-farm.example.org/es/1", "a://b://c/d", "http:///x", "http://m.m.adult-x.example.net?/en/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for chosen in (url_filter.UNWANTED, ()):
        got = rows_of(url_filter.judge(pages, unwanted=chosen), "page_id")
        assert len(got) == len(urls)
        for i, url in enumerate(urls):
            rest = url.split("://", 1)[1] if url and "://" in url else ""
            host = re.match(r"[^/?#]*", rest)[0].lower()
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
            best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
            listed = any(host == u or host.endswith("." + u) for u in chosen)
            want = (host, path, best and best[1] + best[2], best[0] if best else "block" if listed else "allow")
            assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == want


def test_cascade_is_exact_with_crowded_filters(spark, monkeypatch):
    """Filters too small for their keys make false positives at many levels, and none at the end."""
    monkeypatch.setattr(url_filter, "_level", lambda number, keys, rate: url_filter.Bloom(number, 1, 1))
    universe = spark.range(60000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    cascade = url_filter.Cascade.build(universe)
    assert len(cascade.levels) > 3
    assert universe.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0


def test_urls_by_one_and_by_many_segments(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct()
    listing = hosts.where(F.pmod(F.xxhash64("key"), F.lit(3)) == 0)
    one = url_filter.judge(pages, rules=(), unwanted=listing)
    many = url_filter.judge(pages, rules=(), unwanted=listing, segment_keys=7)
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
    listed = {r["key"] for r in listing.collect()}
    assert len(listed) > 14
    for r in one.collect():
        labels = r["host"].split(".")
        assert (r["verdict"] == "block") == any(".".join(labels[i:]) in listed for i in range(len(labels)))


def base_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


@pytest.mark.parametrize("which", ["docs", "corpus"])
def test_quality_counts(which, request):
    df = request.getfixturevalue(which)
    got = rows_of(quality.assess(df.select("doc_id", "text")))
    for r in df.collect():
        want = base_counts(r["text"] or "")
        assert {k: got[r["doc_id"]][k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert got[r["doc_id"]]["base_failed"] == failed
        assert not (failed and got[r["doc_id"]]["kept"])
    assert quality.clean(df).columns == df.columns


def line_kept(line):
    """The line rules, word by word."""
    n = len(words := WORD.findall(line))
    end = line.rstrip(" \t\n\v\f\r" + quality.CLOSERS)[-1:]
    share = [sum(line.count(c) for c in kind) for kind in ("!", quality.RAILS, quality.SYMBOLS)]
    notice = any(x in line.lower() for group in quality.NOTICES.values() for x in group)
    ends = (end != "" and end in quality.ENDS) or n >= 30
    return ends and 2 * share[0] <= n and 4 * share[1] < n and 5 * share[2] < n and not notice and not (n >= 10 and 3 * len(set(words)) < n)


def cleaned(text):
    lines = [x for x in (text or "").split("\n") if not WORD.search(x) or line_kept(x)]
    return "\n".join(lines)


@pytest.mark.parametrize("which", ["docs", "corpus"])
def test_quality_verdicts_by_brute_force(which, request):
    df = request.getfixturevalue(which)
    got = rows_of(quality.assess(df))
    rows = rows_of(quality.clean(df))
    rejected = 0
    for r in df.collect():
        want, mine = base_counts(r["text"] or ""), got[r["doc_id"]]
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        left = cleaned(r["text"])
        kept = not failed and 2 * sum(map(len, WORD.findall(left))) >= want["word_chars"]
        assert (mine["kept"], mine["clean_text"]) == (kept, None if failed else left)
        assert (r["doc_id"] in rows) == kept
        if kept:
            assert rows[r["doc_id"]] == r.asDict() | {"text": left, "n_chars": len(left)}
        rejected += not failed and not kept
    assert rejected or which == "docs"


def test_quality_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.assess(docs).join(labels, "doc_id").where("NOT base_failed")
    rate = {r["quality"]: r["k"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1] > 0.99


def test_line_rules(spark):
    lines = {
        "Prose ends here.": True, "Home | About | Contact | Help.": False, "All Rights Reserved.": False, "no end of a sentence": False,
        "a%%% b$$$ c### d.": False, "Er sagte: „ja“ (und ging.)": True, "x " * 12 + ".": False,
    }
    df = spark.createDataFrame([(k, v) for k, v in lines.items()], "line string, want boolean")
    assert df.where(quality.line_passes(F.col("line")) != F.col("want")).collect() == []


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    assert mixing.mix(none).count() == exact_dedup.dedup(none).count() == quality.clean(none).count() == 0
    assert chat.digests(chat.prefix_targets(turns_of(spark).limit(0))).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
