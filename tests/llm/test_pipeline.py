"""The five stages on odd rows, each against a plain version of it on its own input."""

import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_native_operators import WORD, base_counts, cleaned
from test_ngram_join import brute as linked
from tokenizers import Tokenizer

import corpus_pipeline
from beamquarry.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, row int, key string"


def prose(rng, lines, words=14):
    return "\n".join(" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(words)) + "." for _ in range(lines))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(4, 9)) for _ in range(40)]
    block = prose(rng, 3)
    texts += [f"{prose(rng, 4)}\n{block}\n{prose(rng, 4)}" for _ in range(4)]
    near = prose(rng, 10).split("\n")
    texts += ["\n".join(x if k != j else prose(rng, 1) for k, x in enumerate(near)) for j in range(3)]
    texts += [None, "", " \n\t", "short one.", "Home | About | Contact | Login\n" + prose(rng, 5), prose(rng, 600), "x " * 80, "é日本 – " + prose(rng, 6)]
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t) if t else None, "clash", i, "k") for i, t in enumerate(texts)]
    out += [(None, prose(rng, 5), None, "s1", 1, None, 0, None) for _ in range(2)]  # two texts without id
    out += [(500, prose(rng, 5), "de", "s2", 1, None, 1, None), (500, prose(rng, 6), "de", "s3", 1, None, 2, None)]  # two texts under one id
    out += [out[3], out[3]]  # repeated rows
    return out


def shared_lines(docs, least=20):
    """Line blocks of `least` characters that a document with a smaller id has too, without those that are not shortest."""

    def blocks(lines):
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(map(len, lines[i:j])) >= least:
                    yield i, j
                    break
            for j in range(i, -1, -1):
                if sum(map(len, lines[j : i + 1])) >= least:
                    yield j, i + 1
                    break

    order = [float("inf") if i is None else i for i, _ in docs]
    first = {}
    for at, (_, text) in zip(order, docs, strict=True):
        lines = text.split("\n")
        for i, j in blocks(lines):
            first[tuple(lines[i:j])] = min(at, first.get(tuple(lines[i:j]), at))
    out = []
    for at, (i, text) in zip(order, docs, strict=True):
        lines = text.split("\n")
        gone = {k for a, b in blocks(lines) if first[tuple(lines[a:b])] < at for k in range(a, b)}
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or WORD.search(left):
            out.append((i, left))
    return out


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_match_plain_versions(spark, rows):
    docs, inputs = spark.createDataFrame(rows, SCHEMA), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, "")
        if number < 4:
            assert out.columns == docs.columns
            docs = corpus_pipeline.stored(out, f"test-{name}")
    want = []
    for r in rows:
        counts = base_counts(r[1] or "")
        failed = counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]
        left = cleaned(r[1])
        if not failed and 2 * sum(map(len, WORD.findall(left))) >= counts["word_chars"]:
            want.append((r[0], left))
    good = pairs(inputs[1])
    assert good == sorted(want, key=repr) and 40 < len(good) < len(rows)
    assert pairs(inputs[2]) == sorted(shared_lines(good), key=repr)
    unique = [(i, t) for i, t in pairs(inputs[2])]
    component = linked([(k, t) for k, (_, t) in enumerate(sorted(unique, key=lambda x: (x[0] is None, x[0] or 0)))], 5, 80)
    kept = [x for k, x in enumerate(sorted(unique, key=lambda x: (x[0] is None, x[0] or 0))) if component[k][1] == k]
    ids = Counter(i for i, _ in pairs(inputs[3]))
    assert all(n == 1 for i, n in ids.items() if i is not None)
    assert set(ids) == {i for i, _ in kept}
    taken = defaultdict(int)
    sizes = defaultdict(int)
    for r in mixing.mix(inputs[3]).collect():
        taken[r["source_size"]] += r["taken"]
    for r in inputs[3].collect():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    mixed = defaultdict(int)
    for r in inputs[4].collect():
        mixed[r["source"]] += len(WORD.findall(r["text"]))
    assert len(set(sizes.values())) == len(sizes) and all(mixed[s] == taken[n] for s, n in sizes.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs(inputs[4]))
    pieces = out.collect()
    assert sum(r["length"] for r in pieces) == total
    assert all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in pieces)
    windows = defaultdict(int)
    for r in pieces:
        windows[r["sequence_id"]] += r["length"]
    assert sorted(windows.values())[1:] == [2048] * (len(windows) - 1)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
