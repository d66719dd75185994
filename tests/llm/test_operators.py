"""Operators against brute force on small tables with nulls, ties, empty and repeated rows, and clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import zstandard
from matchloom.llm.chat import format_conversations, read_back, text_part
from matchloom.llm.fingerprints import fingerprint_documents
from matchloom.llm.jaccard_join import near_duplicates, one_of_each
from matchloom.llm.line_dedup import dedup_lines
from matchloom.llm.mixing import mix_sources, mixed_documents
from matchloom.llm.packing import encoder, pack_documents
from matchloom.llm.pii import addresses, emails, find_personal_data, luhn
from matchloom.llm.quality_model import quality_scores
from matchloom.llm.quality_rules import Bands, compression, quality_rules
from matchloom.llm.queries import tokenizer_path
from matchloom.llm.suffix_dedup import brute_force, repeat_report
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, row long, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéfß", k=rng.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 150))) for _ in range(40)]
    rows = base + [base[0]] * 3 + [b + " more" for b in base[:10]] + ["", None, "one", "in " * 300, base[3] + "\n" + base[4], "A" * 500, " \n "]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en" if d % 2 else None, f"s{d % 3}" if d % 5 else None, 1, 2, 3, 4) for d, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def test_suffix_dedup_equals_all_windows(docs, texts):
    want = brute_force(texts, 100)
    for chunk in (4 << 20, 200):
        assert {r[0]: tuple(r)[1:] for r in repeat_report(docs, chunk=chunk).collect()} == want


@pytest.mark.parametrize("words,num,den,crowd", [(3, 90, 100, 64), (5, 80, 100, 2)])
def test_jaccard_join_equals_all_pairs(docs, texts, words, num, den, crowd):
    sets = {}
    for d, t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(words, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r[0]: tuple(r)[1:] for r in near_duplicates(docs, words, num, den, crowd).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}


def test_one_document_stays_of_each_component(docs):
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    assert 0 in kept and not kept & {40, 41, 42}


def test_lines_of_many_sites_stay_once(spark):
    rows = [(i, f"cookie notice for all\nown text number {i}", None, f"s{i}", 1, 2, 3, 4) for i in range(6)] + [(9, None, None, None, 1, 2, 3, 4)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA), min_sites=4).collect()}
    assert got[0].text.startswith("cookie") and all(got[i].text == f"own text number {i}" for i in range(1, 6)) and got[9].text is None


def test_mix_meets_targets(docs, texts):
    rows = mix_sources(docs).collect()
    size = {d: len(WORD.findall(t or "")) for d, t in texts}
    assert {r.doc_id: r["size"] for r in rows} == size
    assert all(r.taken <= 3 * r["size"] for r in rows)
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.target, r.source_size] += r.taken
        target[r.target, r.source_size] = r.source_size
    assert all(abs(taken[t, s] - t) <= 320 and t <= 3 * s + 1e-6 for t, s in target)
    assert abs(sum(t for t, _ in target) - sum(size.values())) < 1e-6
    assert mixed_documents(docs).groupBy("doc_id").count().join(mix_sources(docs).filter("size > 0"), "doc_id").filter("count * size <> taken").count() == 0


def test_packing_is_gapless_and_equals_whole_text_ids(docs, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    ids = encoder(tokenizer_path())
    for _, t in texts:
        assert list(ids(t or "")) == whole.encode(t or "", add_special_tokens=False).ids
    rows = pack_documents(docs, tokenizer_path(), room=64, slack=2).collect()
    bins = defaultdict(list)
    for r in rows:
        part = [*whole.encode(dict(texts)[r.doc_id] or "", add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 64 + 2


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "a\\<|im_end|>\\\\"), (1, 0, "user", None), (1, 1, None, "<|<|"), (2, None, "assistant", "ß\n")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", text_part(F.col("text")))
    got = {r.conv_id: r for r in read_back(format_conversations(messages)).collect()}
    said = "user\n\n" + "\n<|<|\n" + "assistant\na\\<|im_end|>\\\\\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"a\\<|im_end|>\\\\").hexdigest() and got[2].loss_chars == 2


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    order = [d for d, _ in texts]
    for d, t in texts:
        t, follow = t or "", dict(texts)[order[(order.index(d) + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[40].fingerprint and got[40].near_next == 1.0


def test_likeness_is_near_the_exact_generalised_jaccard(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    said, off = [rng.choices(words, k=200)], []
    for i in range(399):
        swapped = rng.choice((10, 20, 40, 80))
        said.append([rng.choice(words) if rng.random() < swapped / 200 else w for w in said[-1]])
    rows = [(i, " ".join(w), None, None, 1, 2, 3, 4) for i, w in enumerate(said)]

    def exact(a, b):
        a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
        return sum((a & b).values()) / sum((a | b).values())

    for r in fingerprint_documents(spark.createDataFrame(rows, SCHEMA)).collect():
        text, follow = rows[r.doc_id][1], rows[(r.doc_id + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 2] + follow[: len(text) // 2]
        for got, j in ((r.near_edited, exact(text, edited)), (r.near_next, exact(text, follow))):
            assert (got * 64).is_integer()
            off.append((got - j, j * (1 - j)))
    assert len(off) == 800 and abs(sum(d for d, _ in off) / len(off)) < 0.01
    assert sum(d * d for d, _ in off) < 1.25 * sum(v for _, v in off) / 64


def test_quality_rules_counts(docs, texts):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for d, t in texts:
        w = WORD.findall(t or "")
        seen = defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
        assert (got[d].n_words, got[d].word_chars, got[d].n_repeat_words) == (len(w), sum(map(len, w)), len(again))
        assert got[d].base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (got[d].base_failed and got[d].kept)


def test_bands_reject_keys_and_repeats_and_keep_prose(spark):
    rng = random.Random(8)
    lines = lambda s, n: "\n".join(s[i : i + 76] for i in range(0, len(s), 76))[:n]
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1"), "doc_id").select("text").collect()]
    bad, good = [], [t for t in prose if len(WORD.findall(t or "")) >= 20]
    for n in (1500, 3040, 8106, 20000):
        bad.append(lines(base64.b64encode(rng.randbytes(n)).decode(), n))
        bad.append(" ".join(base64.b32encode(rng.randbytes(10)).decode() for _ in range(n // 17)))
    bands, press = Bands(), zstandard.ZstdCompressor(level=3)
    for n in (1024, 3000, 8000, 20000):
        bad.append(("".join(rng.choices("abcdefgh ", k=160)) * 200)[:n])
    long = [t for t in good if len(t.encode()) > 8192]
    bad += [t[:4096] + lines(base64.b64encode(rng.randbytes(4096)).decode(), 4096) for t in long[:5]]  # a half
    bad += [t[:4096] + lines(base64.b64encode(rng.randbytes(1600)).decode(), 1600) for t in long[:5]]  # a tail
    assert long and not any(compression(t.encode(), bands, press)[3] for t in bad)
    assert sum(compression(t.encode(), bands, press)[3] for t in good) >= 0.995 * len(good)


def test_personal_data(spark):
    text = "mail a.b@c.de or x@y@z.org.uk, host 1.2.3.4.5.6.7.8 and 300.1.1.1, card 4111 1111 1111 1111, +1 (743) 555-3824"
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert emails(text) == [m.span() for m in email.finditer(text)]
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    assert [(a, b) for a, b, _ in addresses(text)] == [m.span() for m in ip.finditer(text)]
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    rows = [(i, text if i % 3 else None, None, None, 1, 2, 3, 4) for i in range(30)]
    got = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 2, 1, 1) and got[0].spans == ""


@pytest.mark.parametrize("n", [60, 3000])
def test_planted_loose_personal_data_is_added_at_any_size(spark, n):
    rng, rows, want, junk = random.Random(n), [], {}, {}
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    for i in range(n):
        phone = f"({digits(3)}) 555-{digits(4)}"
        head = " ".join(rng.choices(("thing", "river", "over", "stone"), k=6)) + " "
        own = [f"+1 {phone}", f"a{digits(2)}@mail.example.com", "1.2.3.4", phone, f"b{digits(2)} (at) mail.example.com", f"{1990 + i % 9}-{1991 + i % 9}-{1992 + i % 9}"][i % 6]
        rows.append((i, f"{head}{own} over there", None, None, 1, 2, 3, 4))
        if i % 6 in (3, 4):
            want[i] = f"{'phone' if i % 6 == 3 else 'email'}:{len(head)}:{len(head) + len(own)}"
        if i % 6 == 5:
            junk[i] = ""
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] == s for i, s in want.items()) >= 0.95 * len(want)
    assert all(got[i] == s for i, s in junk.items())


def test_classifier_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) > 0.95
    assert sum(r.kept for r in rows if r.quality == 1) / sum(r.quality == 1 for r in rows) > 0.97


@pytest.mark.parametrize("run", [repeat_report, near_duplicates, dedup_lines, mix_sources, fingerprint_documents, quality_rules, find_personal_data, lambda d: pack_documents(d, tokenizer_path())])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
