"""Token counts, periodic runs and the manifest against the library, brute force and a tree built in Python."""

import hashlib
import random
import re
import zlib

import pytest
from matchloom.llm import queries
from matchloom.llm.manifest import build_manifest, folded
from matchloom.llm.periodic_runs import brute_force, periodic_runs, text_runs
from matchloom.llm.queries import tokenizer_path
from matchloom.llm.token_counts import count_tokens, counter
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, i long, slot int, path string, n long, runs string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeéfß中;\r", k=rng.randint(1, 7))) for _ in range(200)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(70)]
    texts += [None, "", " ", "\n\t", "one", "a b " * 40, "x " * 5, "x " * 6, "<s> </s> <0x0A> ▁▁", "q" * 3000, ("lang " * 9 + "\n") * 30, texts[0], texts[0]]
    ids = [*range(len(texts) - 6), None, None, 7, 7, 10**12, -3]
    langs = [None, "", "de", "en", "zz"]
    made = [(d, t, langs[k % 4] if k != 5 else "zz", None if k % 7 == 0 else f"s{k % 3}", None if k % 11 == 0 else len(t or ""), "h", 1, 2, "p", 3, "r") for k, (d, t) in enumerate(zip(ids, texts, strict=True))]
    return [*made, made[3], made[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    return path


def test_counts_equal_the_library(docs, rows):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    want = sorted((r[0] or 0, len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in rows)
    got = count_tokens(docs, tokenizer_path(MODEL), limit=60).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 60) for r in got) and any(r.over_limit for r in got)
    own, rng = counter(tokenizer_path(MODEL)), random.Random(2)
    for k in [*range(400), 30000]:
        text = "".join(rng.choices(["a", "e", " ", "  ", "\n", "\r", ";", "}", "▁", "中", "\0", "é", "\U0001f600", "(", "0", "http", "the"], k=k % 60 if k < 400 else k))
        assert own.count(text) == len(model.encode(text))
    assert own.count(" " * 5000 + "ab" * 5000) == len(model.encode(" " * 5000 + "ab" * 5000))


def test_runs_equal_all_periods():
    rng = random.Random(4)
    for _ in range(60):
        texts = [[]]
        for _ in range(rng.randint(1, 12)):
            made = []
            for _ in range(rng.randint(1, 5)):
                made += rng.choices("abc"[: rng.randint(1, 3)], k=rng.randint(1, 12)) * rng.randint(1, 7)
            texts.append(made)
        texts.append((["a"] * rng.randint(1, 20) + ["b"]) * rng.randint(1, 8))
        for least, exponent in ((6, 4), (1, 3)):
            assert [[tuple(r) for r in found.tolist()] for found in text_runs(texts, least, exponent)] == [brute_force(t, least, exponent) for t in texts]
    assert text_runs([["a"] * 50000, []], 6, 4)[0].tolist() == [[0, 50000, 1]]
    assert text_runs([], 6, 4) == []


def test_run_query_equals_brute_force(spark, folder, rows):
    def planted(doc_id, words):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 or not words:
            return words
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]

    want = []
    for r in rows:
        words = planted(r[0], WORD.findall(r[1] or ""))
        runs = brute_force(words, 6, 4)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), kept)]
        want.append((r[0], len(runs), *best, 1000 * best[1] // best[2] if runs else None, *digests))
    assert any(w[1] for w in want)
    assert sorted(map(tuple, queries.op12_periodic_runs(spark, folder).collect()), key=str) == sorted(want, key=str)


def test_runs_refuse_what_blocks_do_not_find(docs):
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=2)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, changed=0):
    size = None if r[4] is None else r[4] + changed
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], size, r[1])))


def climb(nodes, arity):
    """The root and each node's proof: (slot, siblings) by level."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for k, i in enumerate(at):
            base = i - i % arity
            proofs[k].append((i - base, nodes[base:i] + nodes[i + 1 : base + arity]))
        nodes = [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [i // arity for i in at]
    return nodes[0], proofs


def manifest(rows, arity):
    """(doc_id, leaf, subroot, root, proof) of every row."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
        below[lang] = climb([x[2] for x in by_lang[lang]], arity)
    root, above = climb([below[lang][0] for lang in langs], arity)
    return [(x[3], x[2], below[lang][0], root, proof + above[k]) for k, lang in enumerate(langs) for x, proof in zip(by_lang[lang], below[lang][1], strict=True)]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_a_tree_in_memory(docs, rows, arity):
    found = build_manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], arity)
    hexed = F.transform("path", lambda s: F.struct(s["slot"].alias("slot"), F.lower(F.hex(s["siblings"])).alias("siblings")))
    got = found.select("doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"), hexed.alias("path"), (folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in got)
    want = [(r[0], leaf, sub, root, [(slot, "".join(others)) for slot, others in proof]) for r, leaf, sub, root, proof in manifest(rows, arity)]
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in got), key=str) == sorted(want, key=str)


def test_manifest_query_finds_tampering(spark, folder, rows):
    want = []
    for r, leaf, sub, root, proof in manifest(rows, 2):
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        back = leaf_of(r, 1) if hit else leaf
        for slot, others in proof:
            back = digest(*others[:slot], back, *others[slot:])
        want.append((r[0], leaf, sub, root, digest("".join("".join(others) for _, others in proof)), back, back == root))
    got = sorted(map(tuple, queries.op13_manifest(spark, folder).collect()), key=str)
    assert got == sorted(want, key=str) and {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "one", None, None, None, "h", 1, 2, "p", 3, "r")]])
def test_empty_and_single_tables(spark, rows):
    few = spark.createDataFrame(rows, SCHEMA)
    assert count_tokens(few, tokenizer_path(MODEL)).count() == periodic_runs(few).count() == len(rows)
    made = build_manifest(few, "lang", "doc_id", ["doc_id", "text"]).collect()
    assert len(made) == len(rows) and all(r.path == [] and r.leaf == r.subroot == r.root for r in made)
