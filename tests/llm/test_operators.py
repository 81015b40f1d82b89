"""The training-data operators on small inputs: against brute force, and on odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from skyfringe.llm import ann, jaccard, langid, lm_mixing, mixing, packing, quality, secret_scan, token_count, token_file
from skyfringe.llm.trigram_query import trigram_query, trigrams

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, k long, size string, node string, n_words string"
PROSE = "The quick brown fox jumps over the lazy dog near the old river bank. "


def rows():
    """Nulls, empty and long texts, ties, repeated rows and special strings."""
    long = " ".join(f"word{i % 977}x{i * i % 313}" for i in range(20_000))
    texts = [
        None, "", "   \n\t ", "a", "é", "!!!", PROSE * 12, PROSE * 12, long, "token = 'abcdef123' and secret: x AKIA" + "Z" * 20, "0123456789abcdef" * 3,
        "a<|endoftext|>b  \x1c\x85　c", "Home | About | Contact\n" * 40, "\n".join([PROSE] * 3 + ["All rights reserved", "Privacy policy"]), "漢字 " * 30, "aaa aaa aaa aaa aaa",
    ]
    out = [(i, t, ("en", None, "fr")[i % 3], (None, "b", "a")[i % 3], None if t is None else len(t), "x", 1, "y", "z", "w") for i, t in enumerate(texts)]
    return [*out, out[6], (None, PROSE * 12, None, None, 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_quality_against_python(docs, empty):
    got = {(r.doc_id, r.text): r for r in quality.quality_rules(docs).collect()}
    for doc_id, text, *_ in rows():
        r, w = got[doc_id, text or ""], words(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert not (r.kept and r.base_failed)
    assert quality.quality_rules(empty).count() == 0


def test_line_rules_count_words_not_blanks(spark):
    tabbed, menu = "some\twords\tin\ta\trow\twithout\tan\tend", "  Home    About   Us  "
    r = quality.clean_lines(spark.createDataFrame([(1, f"{tabbed}\n{menu}")], "doc_id long, text string"), max_lost=0.9).first()
    assert r.clean_text == tabbed and r.n_lines_removed == 1


def test_quality_stage_passes_clean_text_on(spark):
    body = " ".join(f"word{k}" for k in range(80)) + "."
    df = spark.createDataFrame([(1, f"{body}\nHome | About | Contact", "en", "a", 999)], "doc_id long, text string, lang string, source string, n_chars long")
    r = corpus_pipeline.quality_stage(spark, df, "").first()
    assert r.text == body and r.n_chars == len(body)


def test_clean_lines_drop_furniture(spark):
    text = PROSE * 2 + "\nHome | About | Contact | Login\nAll rights reserved\n" + PROSE
    r = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.clean_text == PROSE * 2 + "\n" + PROSE and r.n_lines_removed == 2 and r.kept


def brute_spans(text):
    out = []
    for n, rule in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        out += [(m.start(), n, m.end(), rule.kind) for m in re.finditer(pattern, text or "") if len(m[rule.group]) >= rule.least]
    return sorted(out)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_secrets_against_re(docs, empty, limit):
    found = secret_scan.find_secrets(docs, broadcast_rows=limit, block_rows=4).collect()
    assert len(found) == len(rows())
    for r in found:
        assert [tuple(s) for s in r.spans] == brute_spans(r.text)
    assert secret_scan.find_secrets(empty).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(1, "x token = abcdef123456 y")], "doc_id long, text string")
    r = secret_scan.find_secrets(df).select(secret_scan.redact(F.col("text"), F.col("spans")).alias("t")).first()
    assert r.t == "x [assign] y"


@pytest.mark.parametrize("rule", secret_scan.BASE_RULES + secret_scan.MORE_RULES, ids=lambda r: r.kind)
def test_queries_miss_no_match(rule):
    q = trigram_query(rule.pattern)
    samples = ["PassWord: abcdefg", "api_key='abcdefgh'", "apikey=abcdefgh", "secret = abcdefgh", "passwd:abcdefg", "TOKEN:abcdefgh", "AKIA" + "A1" * 10, "ghp_" + "a" * 40, "xoxb-" + "a1" * 10, "AIza" + "x" * 35, "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "-----BEGIN RSA PRIVATE KEY-----"]

    def holds(query, text):
        if query is None or isinstance(query, str):
            return query is None or query in text
        return (all if query[0] == "and" else any)(holds(x, text) for x in query[1])

    hits = [s for s in samples if re.search(rule.pattern, s)]
    assert rule.kind == "hex" or hits
    assert all(holds(q, s.lower()) for s in hits)
    assert trigrams(None) == set()


def encoded():
    t = Tokenizer.from_file(BPE)
    return [t.encode(r[1] or "", add_special_tokens=False).ids for r in rows()]


def test_token_counts(docs, empty):
    want = Counter((r[0], len((r[1] or "").encode()), len(e)) for r, e in zip(rows(), encoded(), strict=True))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(docs, BPE).collect())
    assert got == want
    assert token_count.count_tokens(empty, BPE).count() == 0


def test_long_runs_count_as_the_library_counts():
    t, merger = Tokenizer.from_file(BPE), token_count.RankMerger(BPE)
    rng = np.random.default_rng(3)
    letters = "".join(rng.choice(list("etaoinshrdlu"), 60_000))
    runs = ["a" * n for n in range(60, 140)] + [letters[k : k + n] for k, n in ((0, 65), (100, 300), (400, 5000), (6000, 50_000))] + ["the" * 500, "漢" * 90, "ab" * 200]
    assert merger.counts([r.encode() for r in runs]).tolist() == [len(t.encode(r, add_special_tokens=False).ids) for r in runs]


def test_a_megabyte_without_a_blank(spark):
    run = "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    r = token_count.count_tokens(spark.createDataFrame([(1, run)], "doc_id long, text string"), BPE).first()
    assert r.n_tokens == len(Tokenizer.from_file(BPE).encode(run, add_special_tokens=False).ids)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, empty):
    got = packing.pack_documents(docs, BPE).collect()
    bins, texts = {}, Counter()
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    for r, e in zip(rows(), encoded(), strict=True):
        ids, start = [*e, 2], 0
        first = len(ids) % 1024 or min(1024, len(ids))
        for k in range(-(-len(ids) // 1024)):
            size = first if k == 0 else 1024
            texts[r[0], k, start, size, crc(ids[start : start + size])] += 1
            start += size
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == texts
    assert packing.pack_documents(empty, BPE).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(1, PROSE), (2, "x y z")], "doc_id long, text string")
    t = Tokenizer.from_file(BPE)
    packed = packing.pack_documents(df, BPE, capacity=64, with_ids=True)
    joined = b"".join(bytes(r.ids) for r in packing.sequences(packed).orderBy("sequence_id").collect())
    assert sorted(np.frombuffer(joined, "<u4").tolist()) == sorted([*t.encode(PROSE).ids, 2, *t.encode("x y z").ids, 2])


@pytest.mark.parametrize("seed", range(4))
def test_plan_packs_everything(seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(np.clip(rng.lognormal(5, 1.2, 20_000).astype(int) + 1, 1, 1024), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    placed, bins = Counter(), {}
    for length, rank, n, first, offset in packing.plan_packing(histogram, 1024):
        placed[length] += n
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, length))
    assert placed == histogram
    assert all(sum(x for _, x in b) <= 1024 for b in bins.values())
    assert len(bins) <= 1.02 * sum(k * n for k, n in histogram.items()) / 1024 + 1


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    for kind in (token_file.BITS, token_file.BYTES):
        path = str(tmp_path / f"k{kind}")
        token_file.write_tokens(docs, BPE, path, segment_ids=3000, block=512, kind=kind)
        got = token_file.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
        want = sorted(((r[0] is not None, r[0] or 0), [*e, 2]) for r, e in zip(rows(), encoded(), strict=True))
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) // 4 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            at += r.n_tokens
        assert [r.doc_id for r in got] == [k[1] if k[0] else None for k, _ in want]
        assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((k[1] if k[0] else None, crc(ids)) for k, ids in want)
    token_file.write_tokens(empty, BPE, str(tmp_path / "none"))
    assert token_file.read_tokens(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("kind", [token_file.BITS, token_file.BYTES])
def test_segment_blocks_alone(kind):
    ids = np.random.default_rng(1).integers(0, 70_000, 5000).astype("<u4")
    data = token_file.encode_segment(ids, block=700, kind=kind)
    assert (token_file.decode_segment(data) == ids).all()
    assert (token_file.decode_segment(data, range(2, 3)) == ids[1400:2100]).all()
    assert len(token_file.decode_segment(token_file.encode_segment(ids[:0]))) == 0


def sets(text, n):
    w = words(low(text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(pairs, n, num, den):
    found = [(i, sets(t, n)) for i, t in pairs]
    root = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            a, b = found[i][1], found[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                ri, rj = root[i], root[j]
                root = [min(ri, rj) if x in (ri, rj) else x for x in root]
    return [(found[i][0], len(found[i][1]), min(found[j][0] for j in range(len(found)) if root[j] == root[i])) for i in range(len(found))]


@pytest.mark.parametrize(("n", "num", "limit"), [(4, 85, 10**6), (5, 80, 0)])
def test_jaccard_against_brute_force(spark, n, num, limit):
    rng = np.random.default_rng(7)
    texts = [None, "", "one", "One", "two words", "  "]
    for base in range(12):
        w = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(5, 260)))]
        texts.append(" ".join(w))
        for _ in range(int(rng.integers(0, 12))):
            v = list(w)
            for k in rng.integers(0, len(v), int(rng.integers(0, 1 + len(v) // 25))):
                v[k] = f"z{rng.integers(0, 9)}"
            texts.append(" ".join(v))
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, n=n, num=num, den=100, broadcast_rows=limit).collect())
    assert got == sorted(brute_components(pairs, n, num, 100))


def test_jaccard_odd_rows(docs, empty):
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[6] == by[7] == 6 and by[0] == 0 and by[1] == 1
    assert {r.component_id for r in got if r.doc_id is None} == {6, None}
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("size", [6, 13, 40, 100, 333, 1000, 2500])
@pytest.mark.parametrize("num", [80, 85])
def test_linked_sets_share_signatures(size, num):
    """Signatures, and sketches that don't rule the link out."""
    rng = np.random.default_rng(size)
    scheme = jaccard.PartEnum(num, 100)
    for _ in range(40):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        drop = int(rng.integers(0, size // 5 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, size // 5 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common >= num * (len(a) + len(b) - common) and (len(a) != len(b) or (a != b).any()):
            assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))
            rows = [pd.DataFrame({"node": [k], "size": [len(x)], "sketch": [jaccard._sketch(x)]}) for k, x in enumerate((a, b))]
            assert all(k.all() for k in jaccard._may_link(*rows, num, 100))


def test_words_of_the_same_pieces_differ():
    """The Thue-Morse word and its complement, and words of the same eight-byte pieces in another order."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    pieces = "abcdefgh" + "ijklmnop", "ijklmnop" + "abcdefgh", "abcdefgh" * 2, "abcdefgh"
    hashes, owner = jaccard.word_hashes([word, other, " ".join(pieces), "A a\x00 a"])
    assert len(set(hashes.tolist())) == 8 and owner.tolist() == [0, 1, 2, 2, 2, 2, 3, 3, 3]


def test_block_links_connect_all():
    a = np.arange(100, dtype=np.uint64)
    left, right = [(1, a), (2, a + np.uint64(1)), (3, a + np.uint64(500))], [(4, a), (5, a + np.uint64(2))]
    got = jaccard._block_links(left, right, 85, 100)
    assert len(got) == 3 and all(3 not in x for x in got)


def test_language(spark, docs, empty):
    en, fr = "the cat and the dog with this that from ", "le chat et la maison avec les dans une "
    train = spark.createDataFrame([(en * k, "en") for k in range(2, 9)] + [(fr * k, "fr") for k in range(2, 9)] + [("zzz", None)], "text string, lang string")
    model = langid.train(train)
    assert model[0] == ["en", "fr"]
    df = spark.createDataFrame([(1, en * 3), (2, fr), (3, "123 !! \u00b2\u00bd\u2163"), (4, None), (5, en * 10 + fr * 10)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(1, 5)] == ["en", "fr", "und", "und"]
    assert {x.lang for x in got[5].languages} == {"en", "fr"} and 0.3 < got[5].score < 0.7
    assert langid.identify(docs, model).count() == len(rows())
    assert langid.identify(empty, model).count() == 0
    none = langid.train(train.where("false"))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_language_mixes_of_all_languages(spark):
    words = {"aa": "kata mora tika ", "bb": "huld vorn stec ", "cc": "piqu xeli zoun ", "dd": "brym glaf jysk ", "ee": "quon wexi fyzo "}
    model = langid.train(spark.createDataFrame([(w * k, lang) for lang, w in words.items() for k in range(2, 9)], "text string, lang string"))
    df = spark.createDataFrame([(k, "".join(w * 20 for w in list(words.values())[:k])) for k in range(1, 6)], "doc_id long, text string")
    for r in langid.identify(df, model).collect():
        assert {x.lang for x in r.languages} == set(list(words)[: r.doc_id])
        assert abs(r.score - 1 / r.doc_id) < 0.05


def test_language_mixture_against_plain_loops():
    """Expectation and maximisation for one text after the other, every set in the order of shares."""
    rng = np.random.default_rng(11)
    buckets, langs, rounds, penalty = 128, 4, 8, 3.0
    likelihood = rng.dirichlet(np.full(buckets, 0.3), langs).T.astype(np.float32) + np.float32(1e-5)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n)) for n in (1, 3, 10, 60, 200)] + ["", "12 34"]
    got = langid.mixtures(texts, likelihood, rounds=rounds, penalty=penalty)

    def fit(likely, n, allowed):
        share = np.array(allowed, float) / sum(allowed)
        for _ in range(rounds):
            part = [[p * s for p, s in zip(row, share, strict=True)] for row in likely]
            share = np.array([sum(c * r[k] / sum(r) for c, r in zip(n, part, strict=True)) for k in range(langs)]) / sum(n)
        return share, sum(c * math.log(sum(p * s for p, s in zip(row, share, strict=True))) for c, row in zip(n, likely, strict=True))

    owner, bucket, count = langid.trigram_counts(texts, buckets)
    several = 0
    for k in range(len(texts)):
        at = np.flatnonzero(owner == k)
        if not len(at):
            assert not got[k].any()
            continue
        likely, n = likelihood[bucket[at]].astype(float), count[at].astype(float)
        everything, _ = fit(likely, n, [1] * langs)
        order = np.argsort(-everything, kind="stable")
        price = penalty * math.log(n.sum() + 1)
        alone = [(n * np.log(likely[:, j])).sum() for j in range(langs)]
        best, value = np.eye(langs)[int(np.argmax(alone))], max(alone) - price
        for size in range(2, langs + 1):
            share, likes = fit(likely, n, [float(j in order[:size]) for j in range(langs)])
            if likes - size * price > value:
                best, value = share, likes - size * price
        several += (best > 0).sum() > 1
        assert np.abs(got[k] - best).max() < 1e-3
    assert several


def test_lm_base_and_probability(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {(r.doc_id, r.n_tokens): r for r in lm_mixing.score_documents(docs, held, frequent=2).collect()}
    is_held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tok = [(r[0], [*words(low(r[1])), None]) for r in rows()]
    c = Counter(w for i, ws in tok if not is_held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tok:
        r = got[i, len(ws)]
        assert r.train_tokens == n and r.n_known == sum(w in c for w in ws) and r.held_out == is_held(i)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert r.score < 0
    assert lm_mixing.score_documents(empty, held).count() == 0


@pytest.fixture(scope="module")
def lm_model():
    rng = np.random.default_rng(0)
    counts = np.zeros((256, 256))
    data = np.frombuffer(b"\xff" + (PROSE * 3).lower().encode(), np.uint8)
    np.add.at(counts, (data[:-1], data[1:]), 1)
    return lm_mixing.Codes(counts), rng.integers(-40, 40, 1 << 12).astype(np.int8)


def test_lm_probabilities_add_up(monkeypatch, lm_model):
    """All continuations of a text by one byte, the end included, have its probability together."""
    monkeypatch.setattr(lm_mixing, "_LOWER", np.arange(256, dtype=np.uint8))
    for prefix, ref in ((b"a", None), (b"the quick brown fox jumps over the", b"then the quick brown fox jumps over the lazy dog")):
        whole = lm_mixing.mixed_bits([prefix], [ref], *lm_model)[0]
        longer = lm_mixing.mixed_bits([prefix + bytes([k]) for k in range(256)], [ref] * 256, *lm_model)
        assert abs((2**longer).sum() / 2**whole - 1) < 1e-4


def test_lm_contexts_hold_a_text_and_a_word():
    """A hash is that of the same bytes alone: four before it, or the word so far, in no other text."""
    raw = [b"ab", b"", b"one two " + b"y" * 90, b"two", b"y" * 90]
    data, starts = lm_mixing.flat_bytes([x + b"\xff" for x in raw])
    four, word = lm_mixing.context_hashes(data, starts)
    at = [(k, j) for k, x in enumerate(raw) for j in range(len(x) + 1)]
    for hashes, key in ((four, lambda x, j: (b"\xff" * 4 + x[:j])[-4:]), (word, lambda x, j: x[:j].split(b" ")[-1])):
        seen = {}
        for h, (k, j) in zip(hashes.tolist(), at, strict=True):
            assert seen.setdefault(key(raw[k], j), h) == h
        assert len(set(seen.values())) == len(seen)


def test_lm_texts_are_scored_apart(lm_model):
    raw = [b"ab", (PROSE * 30).encode(), b"x" * 3000, b"", b"ab"]
    raw = [x + b"\xff" for x in raw]
    refs = [None, PROSE.encode(), None, None, b"zz"]
    together = lm_mixing.mixed_bits(raw, refs, *lm_model)
    alone = [lm_mixing.mixed_bits([x], [r], *lm_model)[0] for x, r in zip(raw, refs, strict=True)]
    in_stretches = lm_mixing.mixed_bits(raw, refs, *lm_model, at_once=50)
    assert np.allclose(together, alone, rtol=1e-4) and np.allclose(together, in_stretches, rtol=1e-4)


def test_lm_against_one_decision_at_a_time(lm_model):
    """Mixing, gates and the adaptive map, plainly."""
    codes, table = lm_model
    raw, ref = (PROSE * 4).encode() + b"\xff", (PROSE + "Nothing else.").encode()
    data, starts = lm_mixing.flat_bytes([raw])
    expected, sure = lm_mixing.expected_bytes(data, starts, [ref])
    assert (expected >= 0).any()
    lengths, inputs, depth, state, outcomes = lm_mixing.decision_records(codes.number(data, starts), list(lm_mixing.context_hashes(data, starts)), expected, sure, codes, table)
    weights, refined, bits = {}, {}, 0.0
    logistic = lambda x: 1 / (1 + math.exp(-x))
    for x, d, s, outcome in zip(inputs.astype(float) / lm_mixing.SCALE, depth.tolist(), state.tolist(), outcomes.tolist(), strict=True):
        w = weights.setdefault((d, s), np.array(lm_mixing.START))
        dot = min(12.0, max(-12.0, float(w @ x)))
        band = d, int((dot + 12) * lm_mixing.BANDS / 24.001)
        fine = dot + refined.get(band, 0.0)
        p = logistic(fine)
        bits += math.log2(p if outcome else 1 - p)
        w += 0.02 * (outcome - logistic(dot)) * x
        refined[band] = refined.get(band, 0.0) + 0.02 * (outcome - p)
    assert abs(lm_mixing.mixed_bits([raw], [ref], codes, table)[0] / bits - 1) < 1e-4
    assert lengths.sum() == len(outcomes)


def test_lm_table_counts_a_path_once_a_subtree(spark, lm_model):
    """The table is that of counting every decision of every byte, with one addition for up to three of them."""
    codes, bits = lm_model[0], 12
    texts = [PROSE, "", "x" * 300, PROSE[:50]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    data, starts = lm_mixing.flat_bytes([t.encode() + b"\xff" for t in texts])
    symbols = codes.number(data, starts)
    counts, subtrees = np.zeros((1 << bits, 2)), 0
    for k, hashes in enumerate(lm_mixing.context_hashes(data, starts)):
        for symbol, h in zip(symbols.tolist(), hashes.tolist(), strict=True):
            subtrees += -(-int(codes.length[symbol]) // 3)
            for d in range(codes.length[symbol]):
                cell = symbol * codes.most + d
                block = ((h ^ int(codes.root[symbol * codes.deep + d // 3])) * int(lm_mixing._SPREAD[k]) % 2**32) >> (32 - (bits - 3))
                counts[8 * block + int(codes.local[cell]), codes.bit[cell]] += 1
    want = np.clip(np.round(np.log((counts[:, 1] + 0.1) / (counts[:, 0] + 0.1)) * lm_mixing.SCALE), -127, 127)
    assert (lm_mixing.gather_tables(docs, codes, bits, fan=2) == want).all()
    rows = lm_mixing.table_rows(docs, codes, bits).toPandas()
    assert sum(int(lm_mixing._add_counts([x]).sum()) for x in rows["data"]) == subtrees < counts.sum()


def test_lm_texts_in_groups_are_scored_as_together(lm_model):
    """How many texts go side by side, and how much is prepared at once, changes no score."""
    raw = [(PROSE[k:] * (1 + k % 3)).encode() + b"\xff" for k in range(0, 40, 3)]
    refs = [PROSE.encode() if k % 2 else None for k in range(len(raw))]
    together = lm_mixing.mixed_bits(raw, refs, *lm_model)
    assert np.allclose(lm_mixing.mixed_bits(raw, refs, *lm_model, lanes=4, prepared=300, at_once=30), together, rtol=1e-5)


def test_lm_knows_a_text_that_occurs_twice(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary, 150)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, texts[0], texts[1] + " end"])), "doc_id long, text string")
    got = {r.doc_id: r for r in lm_mixing.score_documents(df, F.col("doc_id").isin(5, 61)).collect()}
    twice = [got[k].bits_per_byte for k in (0, 1, 60, 61)]
    once = [got[k].bits_per_byte for k in range(2, 60)]
    assert got[0].matched and got[61].matched and not got[7].matched
    # 61 is held out, so its copy 1 may learn nothing from it.
    assert max(twice[0], twice[2], twice[3]) < 0.3 * min(once) and not got[1].matched


def test_mixing(docs, empty, spark):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows())
    assert all(r.taken <= 3 * r.size and r.taken == r.size * r.copies for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    assert abs(sum(x[0].target for x in by.values()) - sum(r.size for r in got)) < 1e-6
    again = Counter((r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(5)).collect())
    assert again == Counter((r.doc_id, r.taken) for r in got)
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"))
    for r in mixing.mix_sources(many, band_rows=100).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) < 1
    with_bands = lambda n: {(r.doc_id, r.taken) for r in mixing.mix_sources(many, band_rows=n).collect()}
    assert with_bands(7) == with_bands(100) == with_bands(100_000)
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_against_a_plain_sampler(spark):
    """The same rule on one list a source: keys sorted, whole epochs, the prefix within the rest, one last document."""
    many = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 61 + (F.col("id") % 4 == 0).cast("int") * 200).cast("int")).alias("text"))
    size = F.size(F.array_remove(F.split("text", " "), ""))
    u = (F.pmod(F.xxhash64("doc_id", "source", "text", F.lit(20)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weight = 0.05 + 0.95 * (1 - F.least(F.lit(1.0), F.regexp_count("text", F.lit(r"[#*$%&|<>{}=~^_]")) / F.greatest(size, F.lit(1))))
    docs = many.select("doc_id", "source", size.alias("size"), u.alias("u"), weight.alias("q")).collect()
    sizes = Counter()
    for r in docs:
        sizes[r.source] += r["size"]
    names, total = sorted(sizes), sum(sizes.values())
    weights, full = dict(zip(names, (5, 2, 1, 5), strict=True)), set()
    while True:
        free = total - sum(3 * sizes[s] for s in full)
        level = free / sum(w for s, w in weights.items() if s not in full)
        more = {s for s in names if weights[s] * level >= 3 * sizes[s]}
        if more == full:
            break
        full = more
    want = {}
    for s in names:
        target = min(weights[s] * level, 3 * sizes[s])
        mine = sorted((r for r in docs if r.source == s), key=lambda r: -math.log(r.u) / r.q)
        epochs = int(target // sizes[s])
        room, taken = target - epochs * sizes[s], set()
        for r in mine:
            if r["size"] > room:
                break
            room -= r["size"]
            taken.add(r.doc_id)
        best = min((r for r in mine if r.doc_id not in taken), key=lambda r: (abs(r["size"] - room), -math.log(r.u) / r.q), default=None)
        if best is not None and abs(best["size"] - room) < room:
            taken.add(best.doc_id)
        want |= {r.doc_id: r["size"] * (epochs + (r.doc_id in taken)) for r in mine}
    assert {r.doc_id: r.taken for r in mixing.mix_sources(many, band_rows=50).collect()} == want


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 1000)], "__s string, source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes, (5.0, 2.0, 1.0), 3.0).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), "c": pytest.approx(1980 / 3)}


def exact_neighbours(x, queries, k=20):
    full = x @ x[queries].T
    full[queries, np.arange(len(queries))] = -np.inf
    return {int(q): [int(j) for j in np.lexsort((np.arange(len(x)), -full[:, n]))[:k]] for n, q in enumerate(queries)}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32).astype(float)
    x[100:150] = x[7]
    rows_ = [(i, [float(v) for v in r], "a", 1) for i, r in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (None, [1.0] * 8), (1080, [None] + [1.0] * 7), (1061, [1e-6] * 3)]
    df = spark.createDataFrame(rows_ + [(*r, "b", 2) for r in odd] + [rows_[0]], "vec_id long, embedding array<float>, score string, rank long")
    got = ann.nearest(df, "vec_id % 20 = 0", k=20, recall=1.0, tests=100, leaf_rows=32).collect()
    assert {r.query_id for r in got} == set(range(0, 400, 20))
    for q, want in exact_neighbours(x, np.arange(0, 400, 20)).items():
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == want
        assert all(abs(r.score - float(x[q] @ x[r.vec_id])) < 1e-12 for r in mine)
    assert ann.nearest(df.where("false"), "true").count() == 0


@pytest.mark.parametrize(("n", "clusters"), [(500, 0), (3000, 0), (3000, 60)])
def test_nearest_recall_at_production_parameters(spark, n, clusters):
    """Without structure and with it; how few candidates a query takes depends on that."""
    rng = np.random.default_rng(n + clusters)
    x = rng.normal(size=(n, 32))
    if clusters:
        x = 6 * rng.normal(size=(clusters, 32))[np.arange(n) % clusters] + x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact_neighbours(x, np.arange(0, n, 20))
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * 20 * len(want)


def test_only_leaves_that_are_asked_for_are_scored():
    rng = np.random.default_rng(1)
    x, leaf = rng.normal(size=(90, 4)), np.arange(90) % 9
    members = pd.DataFrame({"leaf": leaf, "cls": np.arange(90), "v": [r.tobytes() for r in x]})
    asked = pd.DataFrame({"cls": [0, 1, 2], "v": [r.tobytes() for r in x[:3]], "leaves": [[3, 5], [8], [0, 77]]})
    got = ann.score_leaves(members, asked, 5)
    for q, leaves in enumerate(asked["leaves"]):
        inside = [j for j in range(90) if leaf[j] in leaves]
        want = sorted(inside, key=lambda j: -float(x[q] @ x[j]))[:5]
        assert got[got["query"] == q]["cls"].tolist() == want


def test_structure_takes_few_leaves(spark):
    rng = np.random.default_rng(3)
    x = 6 * rng.normal(size=(100, 32))[np.arange(5000) % 100] + rng.normal(size=(5000, 32))
    rows_ = [(i, r.tobytes()) for i, r in enumerate(x)]
    forest = ann.grow_forest(x, float(np.linalg.norm(x, axis=1).max()), 3, 7)
    visit = ann.leaves_to_visit(spark.createDataFrame(rows_, "cls long, v binary"), forest, rows_[:40], 21, 0.95)
    assert visit <= 0.1 * 3 * 128


def test_pipeline_on_odd_rows(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long"
    base = [r[:5] for r in rows()] + [(100 + k, " ".join(f"n{k}w{i}" for i in range(80)) + ". token=abcdefgh12345", "en", "a", 9) for k in range(3)]
    spark.createDataFrame(base, names).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} >= {100, 101, 102}
    assert 7 not in {r.doc_id for r in got}
    empty_dir = tmp_path / "none"
    spark.createDataFrame([], names).write.parquet(str(empty_dir / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty_dir)).count() == 0


def test_pipeline_carries_clashing_and_missing_columns(spark, tmp_path):
    body = " ".join(f"word{k}" for k in range(80)) + ". token=abcdefgh12345"
    names = "doc_id long, text string, source string, n_words long, spans string, __row string, kept boolean, size string"
    rows_ = [(k, f"{body} nr{k} " * (k + 1), "s", 7, "x", "y", False, None) for k in range(3)]
    docs = spark.createDataFrame(rows_, names)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.secrets_stage, corpus_pipeline.mixing_stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {(r.n_words, r.spans, r.kept) for r in out.collect()} <= {(7, "x", False)}
    assert "[assign]" in corpus_pipeline.secrets_stage(spark, docs, "").first().text


def test_near_duplicates_keep_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    other, near = b + " end", c + " end"
    data = [(1, a), (1, a), (2, a), (None, a), (3, b), (5, b), (5, c), (None, near), (None, "x y z u v w"), (None, "x y z u v w"), (8, ""), (8, ""), (9, other)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect())
    assert got == sorted([(1, a), (3, b), (5, c), (0, "x y z u v w"), (8, ""), (8, "")])
    linked = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert (None, 57, 5) in linked and (5, 56, 3) in linked and (5, 56, 5) in linked
