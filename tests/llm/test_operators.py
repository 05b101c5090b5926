"""Operators against brute force on small fixtures, and their results on nulls, empty and repeated rows, clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fragloom.llm import bpe, decontaminate, jaccard, language, licenses, lines, quality, rules, substrings, tokens_io
from fragloom.llm.common import crc32_fold, crc32_of_id, scratch, tokenizer_path

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, _tie long, h long, score double, n_words long, cls long, item string, contaminated boolean, n_removed long, found string, k long, `a.b` string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    full = [(i, t, lang, src, len(t or ""), 7, "x", 7, 7, 7.0, 7, 7, "x", False, 7, "x", 7, "x") for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def docs(spark, texts):
    return table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])


EDGE = [(1, None, "en", "s"), (2, "", "en", None), (3, "  \n\t ", None, "s"), (None, "one two three", "en", "s"), (None, None, None, None), (4, "same words in this line", "en", "s"), (4, "same words in this line", "en", "s"), (4, "other words", "en", "s"), (5, "x " * 60_000, "en", "s"), (6, "a" * 30_000, "en", "s"), (7, "1234 5678 !!", "en", "s")]

EVERY = {
    "encode": lambda d: bpe.encode_decode(d, tokenizer_path()),
    "licenses": licenses.scan_licenses,
    "rules": rules.quality_rules,
    "language": lambda d: language.identify(d, language.fit(d)),
    "lines": lines.dedup_lines,
    "jaccard": jaccard.similar_groups,
    "keep_one": jaccard.keep_one,
    "substrings": substrings.cut_repeats,
    "decontaminate": lambda d: decontaminate.contamination(d, d.sparkSession.createDataFrame([(1, None), (2, "same words in this line"), (3, "x " * 50)], "item_id long, text string")),
    "quality": lambda d: quality.score(d, quality.fit(d, d.sparkSession.createDataFrame([(4, 1), (7, 0), (None, 1)], "doc_id long, quality int"))),
}


@pytest.mark.parametrize("name", EVERY)
def test_edges(spark, name):
    """No crash and one row per row (copies aside for keep_one); an empty table gives none."""
    out = EVERY[name](table(spark, EDGE)).collect()
    assert len(out) == (len(EDGE) - 1 if name == "keep_one" else len(EDGE))
    assert EVERY[name](table(spark, [])).count() == 0


def test_token_files_on_edges(spark):
    """Null texts and ids, repeated rows and ids, clashing names: a record each, in order; an empty table gives none."""
    for rows in (EDGE, []):
        path = scratch(spark, "tokens")
        tokens_io.write_tokens(table(spark, rows), path, tokenizer_path())
        out = tokens_io.checksums(tokens_io.read_tokens(spark, path)).orderBy("start").collect()
        assert len(out) == len(rows)
        assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]
        assert sorted((r.id is not None, r.id or 0) for r in out) == [(r.id is not None, r.id or 0) for r in out]
        assert sum(r.n_tokens == 1 for r in out) == sum(not (t or "").strip() for _, t, _, _ in rows)  # the end id alone


def test_folds(spark):
    got = spark.range(50).withColumn("f", crc32_fold("id", 5)).collect()
    assert all(r.f == crc32_of_id(r.id) % 5 == zlib.crc32(str(r.id).encode()) % 5 for r in got)


# -- coding ------------------------------------------------------------------------------------------------------


def hard_texts(n=400):
    r = random.Random(5)
    signs = "abcdeinthtionreÀéßΣσİ日本語́ ' \x85\n0١²!?<|>😀�\x1c"
    out = ["".join(r.choice(signs[: r.choice([3, 8, 20, len(signs)])]) for _ in range(r.choice([3, 30, 300]))) for _ in range(n)]
    return [*out, "x<|endoftext|>y", "th" * 9_000, "a" * 20_000, "".join(r.choice("abcdefghij") for _ in range(30_000))]


def test_encode_like_library(spark):
    model, v = Tokenizer.from_file(tokenizer_path()), bpe.Vocabulary(tokenizer_path())
    for t in hard_texts():
        ids = model.encode(t, add_special_tokens=False).ids
        assert v.encode(t) == ids
        assert list(tokens_io.encode_texts(model, [t], {})[0]) == ids
        machine = v.decoder()
        assert "".join(machine.feed([i]) for i in ids) + machine.end() == model.decode(ids, skip_special_tokens=False)


def test_pieces_are_coded_in_small_lots():
    """What the library returns for a piece is large, so however many are new, few are with it at a time, on one thread."""
    model = tokens_io.library(tokenizer_path())
    sizes = []

    class Counted:
        def encode_batch_fast(self, part, add_special_tokens):
            sizes.append(len(part))
            return model.encode_batch_fast(part, add_special_tokens=add_special_tokens)

    text = " ".join(f"w{i}" for i in range(5_000))
    known = {}
    got = tokens_io.encode_texts(Counted(), [text, None], known)
    assert list(got[0]) == model.encode(text, add_special_tokens=False).ids and len(got[1]) == 0
    assert max(sizes) <= 1_024 and len(known) <= tokens_io.MEMO
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_stream_emits_before_the_end():
    v = bpe.Vocabulary(tokenizer_path())
    seen, fed = [], []

    def symbols():
        for s in "ab" * 40_000:
            fed.append(s)
            yield s
            if len(fed) == 70_000:
                assert sum(map(len, seen)) > 10_000

    v.stream(symbols(), seen.append)
    assert len(seen) > 1 and "".join(v.text[i] for part in seen for i in part) == "ab" * 40_000


def test_plain_decoder_holds_unfinished_characters():
    v = bpe.Vocabulary(tokenizer_path())
    ids = v.encode("Grüße 日本 😀 ok")
    machine = v.decoder(plain=True)
    assert "".join(machine.feed([i]) for i in ids) + machine.end() == "grüße 日本 😀 ok "
    lone = v.decoder(plain=True)
    assert lone.feed([v.ids[v.signs[0xE6]]]) == "" and lone.end() == "�"


def test_records():
    ids = np.array([0, 255, 256, 65_535, 65_536, 2**24, 2**32 - 1] * 400, "u4")
    record = tokens_io.pack(ids)
    assert (tokens_io.unpack(record) == ids).all()
    assert all(tokens_io.token_at(record, i) == ids[i] for i in range(len(ids)))
    assert len(tokens_io.unpack(tokens_io.pack(np.zeros(0, "u4")))) == 0
    with pytest.raises(IndexError):
        tokens_io.token_at(record, len(ids))


def test_token_files(spark):
    texts = ["b c d", None, "hello world " * 300, "", "日本"]
    path = scratch(spark, "t")
    tokens_io.write_tokens(docs(spark, texts), path, tokenizer_path())
    records = tokens_io.read_tokens(spark, path)
    got = {r.id: r for r in tokens_io.checksums(records).collect()}
    model, start = Tokenizer.from_file(tokenizer_path()), 0
    for i, t in enumerate(texts):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    wanted = spark.createDataFrame([(2, 0), (2, 600), (2, 601), (9, 0)], "id long, i long")
    ids = [*model.encode(texts[2], add_special_tokens=False).ids, 1]
    found = {(r.id, r.i): r.token for r in tokens_io.tokens_at(records, wanted).collect()}
    assert found == {(2, 0): ids[0], (2, 600): 1, (2, 601): None, (9, 0): None}


# -- classification ----------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    all_docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(all_docs.where(crc32_fold("doc_id", 4) != 2))
    got = language.identify(all_docs, model).join(all_docs.select("doc_id", "lang"), "doc_id").where(crc32_fold("doc_id", 4) == 2)
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97


def test_language_mixture(spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    by = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 3000 and 4000").select("lang", "text").collect()}
    got = language.infer(by["de"] + "\n" + by["fr"], *model)
    assert sorted(got[2]) == ["de", "fr"] and abs(sum(got[3]) - 1) < 1e-6 and min(got[3]) > 0.3
    assert language.infer("123 ?!", *model)[0] == language.infer(None, *model)[0] == "und"


def test_quality_held_out(spark):
    all_docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(all_docs.where(crc32_fold("doc_id", 5) != 0), labels)
    held = all_docs.join(labels, "doc_id").where(crc32_fold("doc_id", 5) == 0)
    got = quality.score(held, model).join(labels, "doc_id").groupBy("quality").agg(F.avg((F.col("score") >= 0.3).cast("int")).alias("p")).collect()
    share = {r.quality: r.p for r in got}
    assert share[1] >= 0.99 and share[0] <= 0.1


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    m = quality.Model(np.ones(quality.WIDTH, "f4"), rng.normal(size=(quality.WIDTH, 8)).astype("f4"), np.empty((0, 8)), np.empty(0))
    x = rng.random((300, quality.WIDTH)).astype("f4")
    v = x @ m.topics
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    m = m._replace(vectors=v[:100], labels=(rng.random(100) > 0.5).astype("f4"))
    got = quality.vote(x, m)
    for i in range(300):
        sims = v[i] @ m.vectors.T
        near = np.argsort(-sims)[: quality.NEIGHBOURS]
        w = np.maximum(sims[near], 0).astype("f8") ** 8 + 1e-9
        assert abs(got[i] - (w * m.labels[near]).sum() / w.sum()) < 1e-4


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rule_measures(t):
    w = words_of(t)
    seen = Counter(zip(w, w[1:], w[2:]))
    cover = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for d in range(3)}
    full = [x for x in (t or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(cover)


def test_rule_measures(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", "a b c a b c", "a a a a a", "x\nx\n \n \nx\ty\x0bz", "# | <é> 日 本\x85x", "a b a b a b c\n" * 40]
    got = rules.base_metrics(docs(spark, texts), ["doc_id"]).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == rule_measures(texts[r.doc_id])


def test_rule_fences(spark):
    r = random.Random(2)
    clean = [(i, " ".join(f"w{r.randrange(9999)}" for _ in range(80)), "en", f"s{i % 2}") for i in range(500)]
    noisy = [(1000 + i, " ".join(f"w{r.randrange(9999)}###" for _ in range(80)), "en", "s0") for i in range(20)]
    got = {x.doc_id: x for x in rules.quality_rules(table(spark, clean + noisy)).collect()}
    assert all(got[i].kept for i, *_ in clean) and not any(got[i].kept for i, *_ in noisy)
    parts = rules.with_ratios(rules.base_metrics(table(spark, clean), ["lang", "source"]))
    fine = rules.sketches(parts, ["lang", "source"])
    a = {tuple(x) for x in rules.merge(fine, ["lang"]).collect()}
    assert a == {tuple(x) for x in rules.sketches(parts, ["lang"]).collect()}


def test_expressions():
    ok = {
        "MIT": ({"mit"}, True), "MIT OR GPL-3.0-only": ({"mit", "gpl-3.0-only"}, True), "MIT AND GPL-3.0-only": ({"mit", "gpl-3.0-only"}, False),
        "GPL-2.0-only OR MIT AND ISC": ({"gpl-2.0-only", "mit", "isc"}, True), "(GPL-2.0-only OR MIT) AND GPL-3.0": ({"gpl-2.0-only", "mit", "gpl-3.0"}, False),
        "GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0": ({"gpl-2.0-only", "apache-2.0"}, True),
    }
    for text, want in ok.items():
        assert licenses.parse(text) == want, text
    for bad in ("", "MIT OR", "OR MIT", "(MIT", "MIT)", "MIT ISC", "MIT AND AND ISC", "()", "MIT & ISC"):
        assert licenses.parse(bad) is None, bad


def test_licenses(spark):
    texts = ["Released under the MIT License. under the mit\nlicense!", "Apache License, Version 2.0 and CC-BY-NC", "cc by nc cc by nc", "under the mit licenses", "/* SPDX-License-Identifier: MIT OR GPL-2.0-only */\nx", "spdx-license-identifier: (MIT\nGNU General Public License, version 3", None, "the\x85mit license under the mit license"]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), sorted({x for _, x in at}))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
    assert got[4].labels == ["gpl-2.0-only", "mit"] and got[4].usable and got[4].score == 1.0
    assert got[5].labels == ["gpl-3"] and got[5].expressions == []


def test_expression_with_text_behind_it():
    found = licenses.automaton(licenses.BASE_PHRASES, licenses.EXTRA_PHRASES)
    want = {
        "MIT. Some prose": ["mit"], "MIT Copyright 2020 X": ["mit"], "MIT. */": ["mit"], "MIT. */ -->": ["mit"], "MIT-->": ["mit"], "MIT */ int x;": ["mit"],
        "(MIT OR GPL-2.0+) and this notice": ["gpl-2.0+", "mit"], "MIT or later": ["later", "mit"], "MIT or later ones": ["mit"], "OpenSSL, see there": ["openssl"],
        "GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0 text": ["apache-2", "gpl-2.0-only"], "MIT OR": ["mit"], "see the file": [], "(MIT": [], "OR MIT": [], "": [], "...": [],
    }
    for text, labels in want.items():
        got = licenses.scan_text(f"// SPDX-License-Identifier: {text}\nnext", found)
        assert got[5] == labels and bool(got[6]) == bool(labels), (text, got)
    assert licenses.scan_text("spdx-license-identifier: MIT " + "# " * 100_000 + "x", found)[5] == ["mit"]


# -- repeats -----------------------------------------------------------------------------------------------------


def cut_lines(text):
    out, part, last = [], [], 0
    for line in text.split("\n"):
        h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
        part.append(line)
        if (h + lines.FACTOR * last) % lines.MODULUS % lines.DIVISOR == 0:
            out.append(part)
            part = []
        last = h
    return [*out, part] if part else out


def without_repeats(rows):
    """Texts of (id, text) rows, ids ascending, without later equal chunks."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        kept = []
        for part in cut_lines(t):
            chunk = "\n".join(part)
            many = sum(bool(words_of(x)) for x in part) >= 2
            if not (many and chunk in seen):
                kept.append(chunk)
            if many:
                seen.add(chunk)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(spark):
    r = random.Random(3)
    shared = [f"shared line {k}" for k in range(12)]
    texts = ["\n".join([f"own {i} {k}" for k in range(r.randrange(4))] + shared * (i % 3 == 0) + [f"end {i}", "", ""]) for i in range(40)]
    got = {x.doc_id: x for x in lines.dedup_lines(docs(spark, texts)).collect()}
    want = without_repeats(enumerate(texts))
    assert {i: x.text for i, x in got.items()} == want
    assert sum(x.n_removed for x in got.values()) > 10 and got[0].text == texts[0]
    assert got[0]["a.b"] == "x" and got[0].source == "s"


def bench_overlaps(text, items):
    memo = {}
    d = decontaminate.tokens(text, memo)
    out = set()
    for item, t in items:
        b = decontaminate.tokens(t, memo)
        if len(b) >= 8 and any(decontaminate.overlap(d, b, k) for k in range(-len(b), len(d))):
            out.add(item)
    return out


def best_span(same, least):
    """Start, words, equal words of the best of all spans."""
    spans = [(sum(same[a:b]), a - b, -a) for a in range(len(same)) for b in range(a + least, len(same) + 1)]
    equal, size, start = max((x for x in spans if 5 * x[0] >= -4 * x[1]), default=(0, 0, 0))
    return (-start, -size, equal) if equal else None


def test_overlap_is_exact():
    r = random.Random(8)
    for n, changed in [(12, 1), (12, 2), (13, 1), (14, 2), (15, 3), (16, 3), (20, 4), (9, 1), (40, 8)] * 20:
        item = np.arange(1, n + 1, dtype="u8")
        doc = np.concatenate((np.full(5, 900, "u8"), item, np.full(7, 901, "u8")))
        doc[5 + np.array(r.sample(range(n), changed))] = 902
        assert decontaminate.overlap(doc, item, 5) == (5 + (s := best_span(list(doc[5 : 5 + n] == item), min(12, n)))[0], *s[1:])
    for _ in range(400):  # random likeness, items that begin or end outside the document
        item, k = np.arange(1, r.choice([8, 12, 30, 60]) + 1, dtype="u8"), r.randrange(-20, 20)
        doc = np.array([i - k + 1 if r.random() < r.choice([0.7, 0.9]) else 999 for i in range(50)], "i8").astype("u8")
        lo, hi = max(0, -k), min(len(item), len(doc) - k)
        want = best_span([bool(item[i] == doc[i + k]) for i in range(lo, hi)], min(12, len(item)))
        assert decontaminate.overlap(doc, item, k) == (want and (lo + k + want[0], *want[1:]))


def test_decontamination(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(text(r.choice([5, 9, 12, 40])))) for k in range(30)]
    texts, planted = [], {}
    for i in range(120):
        body = text(100)
        if i % 2:
            item, t = r.choice(items)
            part = t.split()
            for k in range(2, len(part), 6):
                part[k] = "changed"
            if len(part) > 12:
                planted[i] = item
            body[50:50] = part
        texts.append(" ".join(body))
    bench = spark.createDataFrame(items + [(99, None), (98, items[3][1])], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.contamination(docs(spark, texts).drop("item", "contaminated"), bench).collect()}
    want = {i: bench_overlaps(t, items) for i, t in enumerate(texts)}
    assert {i for i, x in got.items() if x.contaminated} == {i for i, w in want.items() if w}
    assert all(got[i].n_items == len(want[i]) for i in got)
    assert all(got[i].contaminated for i in planted) and planted


def test_items_without_id_and_short_items(spark):
    long = " ".join(f"q{k}" for k in range(20))
    texts = [f"a b {long} c", "one Two, three four! one two three", "one two four three", "nothing", f"{long} one two three"]
    bench = spark.createDataFrame([(None, long), (5, "one two three"), (6, ""), (7, "x")], "item_id long, text string")
    got = {x.doc_id: (x.contaminated, x.n_items, x.item, x.start, x.words, x.equal) for x in decontaminate.contamination(docs(spark, texts).drop("item", "contaminated"), bench).collect()}
    no = (False, 0, None, None, None, None)
    assert got == {0: (True, 1, None, 2, 20, 20), 1: (True, 1, 5, 0, 3, 3), 2: no, 3: no, 4: (True, 2, None, 0, 20, 20)}


def groups_of(texts, size=4, percent=85):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = words_of((t or "").translate(low))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, groups=6, size=40):
    r = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"v{r.randrange(500)}" for _ in range(r.choice([20, 90, 160]))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(6)):
                k = r.randrange(len(t))
                t[k : k + r.choice([0, 1, 1])] = [r.choice(["New", "x", f"u{r.randrange(999)}"])]
            texts.append(" ".join(t))
    r.shuffle(texts)
    return [*texts, None, "", "one two", "One  two", "three"]


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, size, percent):
    texts = near_copies(size)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.similar_groups(docs(spark, texts), size=size, percent=percent).collect()}
    assert got == dict(enumerate(groups_of(texts, size, percent)))
    if size == 5:
        kept = {x.doc_id for x in jaccard.keep_one(docs(spark, texts)).collect()}
        assert kept == {root for _, root in groups_of(texts, 5, 80)}


def cut_bytes(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("max_group", [substrings.MAX_GROUP, 3])
def test_substrings(spark, max_group):
    r = random.Random(6)
    make = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    shared = [make(n) for n in (190, 210, 260, 900)]
    texts = [make(r.randrange(400)) + r.choice(shared) + make(r.randrange(400)) for _ in range(60)]
    for k in range(15):  # near copies whose changes split the windows
        t = list(shared[3])
        t[r.randrange(900)] = "Z"
        texts.append("".join(t))
    texts += [None, "", "x" * 199, "y" * 200, "z" * 201, "ab" * 500, "same" * 60, "same" * 60]
    got = {x.doc_id: bytes(x.kept) for x in substrings.cut_repeats(docs(spark, texts), max_group=max_group).collect()}
    assert [got[i] for i in range(len(texts))] == cut_bytes(texts)


def test_merge_sort_orders_suffixes():
    r = random.Random(7)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(3000)).encode(), "u1")
    s = substrings.Suffixes(data, 40)
    start = np.array([r.randrange(2900) for _ in range(700)])
    begin, size = np.repeat([0, 300, 301], [300, 1, 399]), np.repeat([300, 1, 399], [300, 1, 399])
    order = s.merge_sort(start, begin, size)
    for a, b in ((0, 300), (300, 301), (301, 700)):
        got = [data[start[k] : start[k] + 40].tobytes() for k in order[a:b]]
        assert got == sorted(got) and sorted(order[a:b]) == list(range(a, b))


def test_short_texts_share_passes(monkeypatch):
    """Short texts are hashed together, with the segments that each has alone (F1)."""
    r = random.Random(3)
    texts = [np.frombuffer(bytes(r.choice(b"abc ") for _ in range(r.choice([0, 150, 200, 260, 900]))), "u1") for _ in range(600)] + [np.zeros(5_000, "u1")]
    alone = [substrings.segments([t]) for t in texts]
    calls, real = [], substrings.gram_hashes
    monkeypatch.setattr(substrings, "gram_hashes", lambda d: (calls.append(len(d)), real(d))[1])
    for piece in (substrings.PIECE, 300):
        monkeypatch.setattr(substrings, "PIECE", piece)
        got = substrings.segments(texts)
        windows = [(i, a + w, a + b) for i, a, n, b in zip(*(x.tolist() for x in got[:4])) for w in range(n)]
        want = [(i, a + w, a + b) for i, x in enumerate(alone) for a, n, b in zip(*(y.tolist() for y in x[1:4])) for w in range(n)]
        assert windows == want
        if piece > 300:
            assert (got[4] == np.concatenate([x[4] for x in alone])).all() and len(calls) < 60


def test_equal_windows_need_no_sort(monkeypatch):
    """Windows meet by their hashes; only classes whose bytes differ are sorted, with the same result (F1)."""
    r = random.Random(4)
    passage, length = bytes(r.choice(b"abcdefgh ") for _ in range(120)), 40
    h, before, segs = [], [], []
    for _ in range(70):
        b, n, t = r.randrange(20, 40), r.randrange(1, 20), bytearray(passage)
        t[r.randrange(120)] = 90
        h, before, segs = [*h, r.randrange(3)], [*before, b], [*segs, bytes(t[40 - b : 80 - b + n - 1])]
    spots = Counter((x, b - w, s[w : w + length]) for x, b, s in zip(h, before, segs) for w in range(len(s) - length + 1))
    want = [[spots[x, b - w, s[w : w + length]] > 1 for w in range(len(s) - length + 1)] for x, b, s in zip(h, before, segs)]
    find = lambda: [m.tolist() for m in substrings.equal_windows(np.array(h, "u8"), np.array(before, "i8"), segs, length)]
    sorts, real = [], substrings.Suffixes.merge_sort
    monkeypatch.setattr(substrings.Suffixes, "merge_sort", lambda self, *a: (sorts.append(1), real(self, *a))[1])
    assert find() == want and not sorts
    monkeypatch.setattr(substrings.Suffixes, "windows", lambda self, x: np.zeros(len(x), "u8"))
    assert find() == want and sorts
