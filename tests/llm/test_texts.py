"""Text operators against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.llm import components, debruijn, decontaminate, jpeg, langid, minhash, suffixes, toxicity, words
from countloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A_Z = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORD, ALNUM = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("spans", F.lit("clash")).withColumn("score", F.lit(1.5))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Nulls, empties, ties, repeats, edits, shared passages, a long text."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    out = [None, "", "   \n", "one", "One", "two words", base, base, base.upper()]
    for i in range(12):
        w = base.split()
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = f"edit{i}"
        out.append(" ".join(w))
    out += [prose(rng, 30) + " " + passage + "\t" + prose(rng, 40) for _ in range(10)]
    out += [prose(rng, rng.randrange(3, 80)) for _ in range(20)]
    out += [prose(rng, 5000), "é" * 500, "ab " * 400, "a" * 1200, "\U0001f600 " * 3]
    return out


def raw(t):
    return (t or "").encode()


def test_words():
    texts = [b"  Hello wORLD\nx", b"", b"a b", b" \t ", "é ü".encode(), b"end", b"start"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    w = words.Words(data, off, lower=True)
    got = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in t.translate(A_Z).split()]
    assert np.diff(w.first).tolist() == [len(t.split()) for t in texts]
    assert len(set(w.hashes().tolist())) == len(set(got))


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 1 << 62, 700).astype(np.uint64)
    for w in (1, 2, 37, 700):
        got = words.sliding_first_min(x, w)
        assert all(got[i] == i + np.argmin(x[i : i + w] >> np.uint64(24)) for i in range(len(x) - w + 1))


def test_super_minhash_is_the_sequential_one():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 3, 40, 0, 300)]
    sig = minhash.signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 16)
    for s, row in zip(sets, sig, strict=True):
        want = [2**64 - 1] * 16
        for e in s.tolist():
            p = list(range(16))
            for j in range(16):
                r = int(words.mix(np.array([e], np.uint64) + minhash._M[j : j + 1] * np.uint64(j + 1))[0])
                k = j + ((r & 0xFFFFFFFF) * (16 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], j << 32 | r >> 32)
        assert row.tolist() == want


def near_truth(texts, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(raw(t).translate(A_Z))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("rounds", [0, 2])
@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent, rounds):
    texts = corpus()
    got = minhash.near_duplicates(docs_of(spark, texts), Scratch(spark), percent=percent, rounds=rounds).collect()
    truth = near_truth(texts, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == truth
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_near_duplicates_without_rows_or_ids(spark):
    docs = docs_of(spark, ["a b c d e f"] * 3)
    assert minhash.near_duplicates(docs.limit(0), Scratch(spark)).isEmpty()
    odd = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(odd, Scratch(spark)).collect()}
    assert got == {None: None, 1: 1, 2: 1}


def test_deduplicated_keeps_one_of_each_group(spark):
    texts = corpus()
    docs = docs_of(spark, texts)
    out = minhash.deduplicated(docs.unionByName(docs.where("doc_id < 10")), Scratch(spark), percent=80)
    truth = near_truth(texts, 80)
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, (_, c) in truth.items() if c == i) and out.columns == docs.columns


def test_components_of_a_chain(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (502, 501)]
    rng.shuffle(edges)
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "c").collect()))
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 500 for i in (500, 501, 502))


def test_automaton_by_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        letters, window = "abcde"[: rng.randint(2, 5)], rng.randint(2, 5)
        items = [" ".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))]
        docs = [" ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 40))) for _ in range(5)]
        m = decontaminate.Matcher(list(range(len(items))), items, window)
        off = np.cumsum([0, *map(len, docs)])
        w, hit, found = m.slice(np.frombuffer("".join(docs).encode(), np.uint8), off)
        for d, doc in enumerate(docs):
            x, marks, names = doc.split(), [False] * len(doc.split()), set()
            for k, item in enumerate(items):
                y = item.split()
                n = min(window, len(y))
                for i in range(len(y) - n + 1 if n else 0):
                    for j in range(len(x) - n + 1):
                        if x[j : j + n] == y[i : i + n]:
                            names.add(k)
                            marks[j : j + n] = [True] * n
            assert marks == hit[w.first[d] : w.first[d + 1]].tolist() and names == found[d]


def test_longest_matching_lengths():
    a = decontaminate.Automaton([[1, 2, 3, 4], [3, 4, 5]], 3)
    assert a.stream([9, 1, 2, 3, 4, 5, 2, 3])[2] == [0, 1, 2, 3, 4, 3, 1, 2]


@pytest.mark.parametrize("limit", [300, 1 << 24])
def test_decontamination(spark, limit):
    texts = corpus()
    items = [(0, texts[25]), (1, "Two words"), (2, None), (3, ""), (4, "!!"), (11, texts[6]), (11, texts[6])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(raw(t).translate(A_Z))
        k = min(10, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[j : j + k])].add(i)
    got = {r.doc_id: r for r in decontaminate.report(docs_of(spark, texts), bench, Scratch(spark), items_limit=limit).collect()}
    for i, t in enumerate(texts):
        w, hit, ids = ALNUM.findall(raw(t).translate(A_Z)), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    ids |= windows[tuple(w[j : j + k])]
                    hit |= set(range(j, j + k))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert sum(s.stop - s.start for s in r.spans) == len(hit)
    out = decontaminate.cleaned(docs_of(spark, texts), bench, Scratch(spark), items_limit=limit)
    left = {r.doc_id: r for r in out.collect()}
    assert all((i in left) == (got[i].n_hit <= 0.5 * got[i].n_words) for i in range(len(texts)))
    assert all(left[i].text == texts[i] for i in left if not got[i].n_hit)
    assert not decontaminate.report(out, bench, Scratch(spark)).where("n_hit > 10").count() and all(r.n_chars == len(r.text or "") for r in left.values())


def test_an_empty_benchmark_hits_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(docs_of(spark, ["a b", None]), bench, Scratch(spark)).where("contaminated").isEmpty()


def test_jpeg_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 575, 576, 577, 5000, 1_700_000):
        text = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        payload, thumb, wide, high = jpeg.read(jpeg.store(text))
        assert payload == text.ljust(max(576, -(-n // 576) * 576), b"\xff") and thumb.shape == (high // 8, wide // 8)


def test_sequential_decoder_agrees():
    image = jpeg.parse(jpeg.store(bytes(range(256)) * 20 + "some text to be stored, äöü ".encode() * 60))
    (names, data), = image["scans"]
    assert (jpeg.coefficients([image])[0][1] == jpeg.interleaved(image, names, data)[1]).all()


def test_codes_of_uneven_length_are_decoded():
    """The stored form is entropy coded: text takes fewer bits than bytes that need the long codes."""
    assert len({n for n, _, _ in jpeg.codes(*jpeg.AC_TABLE)}) > 2
    text, rare = b"plain letters are short " * 240, bytes([126, 127, 129, 130] * 1440)
    assert len(jpeg.store(text)) < 0.95 * len(jpeg.store(bytes([200, 255] * 2880))) and jpeg.read(jpeg.store(rare))[0] == rare


def test_jpeg_with_runs_and_restarts():
    """Two blocks, zero runs, an end of block and a restart marker, coded by hand with tables of uneven length."""
    dc, ac = (bytes([0, 2] + [0] * 14), bytes([0, 3])), (bytes([0, 3] + [0] * 14), bytes([0x00, 0x21, 0xF0]))
    # codes: dc 00 -> 0, 01 -> 3 bits; ac 00 -> end, 01 -> two zeros and one bit, 10 -> sixteen zeros
    first = "01" + "101" + "01" + "1" + "10" + "01" + "0" + "00"  # 5; +1 at 3; 16 zeros; -1 at 22; end
    second = "01" + "010" + "00"  # -5, as the restart sets the prediction back
    pack = lambda b: int(b.ljust(-(-len(b) // 8) * 8, "1"), 2).to_bytes(-(-len(b) // 8), "big").replace(b"\xff", b"\xff\0")
    seg = jpeg._segment
    file = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([2] * 64)) + seg(0xC0, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00") + seg(0xC4, b"\x00" + dc[0] + dc[1] + b"\x10" + ac[0] + ac[1])
    file += seg(0xDD, b"\x00\x01") + seg(0xDA, b"\x01\x01\x00\x00\x3f\x00") + pack(first) + b"\xff\xd0" + pack(second) + b"\xff\xd9"
    image = jpeg.parse(file)
    got = jpeg.coefficients([image])[0][1]
    assert (jpeg.interleaved(image, *image["scans"][0])[1] == got).all()
    want = np.zeros((2, 64), int)
    want[0, [0, 3, 22]], want[1, 0] = (5, 1, -1), -5
    assert (got == want).all() and jpeg.thumbnail(image, {1: got}).tolist() == [[129, 126]]


@pytest.mark.parametrize("cut", [0, 1, 10, 200, -3])
def test_broken_jpegs_are_errors(cut):
    with pytest.raises(jpeg.BadJpeg):
        jpeg.read(jpeg.store(b"text")[:cut])


def test_media(spark):
    texts = corpus()
    for r in jpeg.media(docs_of(spark, texts)).collect():
        t = raw(texts[r.doc_id])
        payload = t.ljust(max(576, -(-len(t) // 576) * 576), b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media) and jpeg.read(bytes(r.media))[0] == payload


def removed_units(items, window):
    """For each sequence, which units windows cover that start twice or more in all of them."""
    count = collections.Counter(tuple(x[j : j + window]) for x in items for j in range(len(x) - window + 1))
    out = []
    for x in items:
        marks = [False] * len(x)
        for j in range(len(x) - window + 1):
            if count[tuple(x[j : j + window])] > 1:
                marks[j : j + window] = [True] * window
        out.append(marks)
    return out


@pytest.mark.parametrize("hot", [0, 4000])
def test_debruijn(spark, hot):
    texts = corpus(2)
    items = [WORD.findall(raw(t)) for t in texts]
    got = {r.doc_id: r for r in debruijn.removed(docs_of(spark, texts), Scratch(spark), hot=hot).collect()}
    for i, (x, marks) in enumerate(zip(items, removed_units(items, 35), strict=True)):
        kept = b" ".join(w for w, m in zip(x, marks, strict=True) if not m)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept) == (len(x), sum(marks), hashlib.sha256(kept).hexdigest(), kept.decode())


@pytest.mark.parametrize(("window", "gram", "hot"), [(120, 16, 0), (120, 16, 3), (suffixes.WINDOW, suffixes.GRAM, 4000)])
def test_suffix_arrays(spark, window, gram, hot):
    texts = [t and t[:4000] for t in corpus(3)]
    items = [raw(t) for t in texts]
    got = {r.doc_id: r for r in suffixes.removed(docs_of(spark, texts), Scratch(spark), window=window, gram=gram, hot=hot).collect()}
    for i, (x, marks) in enumerate(zip(items, removed_units(items, window), strict=True)):
        kept = bytes(b for b, m in zip(x, marks, strict=True) if not m)
        spans = sum(m and not (j and marks[j - 1]) for j, m in enumerate(marks))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(x), sum(marks), spans, hashlib.sha256(kept).hexdigest())


def test_substring_operators_on_empty_tables(spark):
    docs = docs_of(spark, ["a"]).limit(0)
    assert debruijn.removed(docs, Scratch(spark)).isEmpty() and suffixes.removed(docs, Scratch(spark)).isEmpty()


def test_repeated_rows_are_repeats(spark):
    rng = random.Random(9)
    docs = docs_of(spark, [prose(rng, 200), prose(rng, 200)])
    out = debruijn.removed(docs.unionByName(docs.where("doc_id = 0")), Scratch(spark)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(0, 200), (0, 200), (1, 0)]


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_in_polynomial_hashes(spark):
    """Thue-Morse words and their complements agree under every polynomial hash modulo 2^64."""
    one, other = thue_morse(1024), thue_morse(1024, "ba")
    docs = docs_of(spark, [" ".join([w] + [f"w{i}" for i in range(34)]) for w in (one, other)])
    assert {r.component_id for r in minhash.near_duplicates(docs_of(spark, [one + " a b c d", other + " a b c d"]), Scratch(spark)).collect()} == {0, 1}
    bench = spark.createDataFrame([(1, one)], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.report(docs, bench, Scratch(spark)).orderBy("doc_id").collect()] == [1, 0]
    assert {r.n_removed for r in debruijn.removed(docs, Scratch(spark)).collect()} == {0}
    texts = docs_of(spark, [" ".join(thue_morse(2048, x)) for x in (["a", "b"], ["b", "a"])] + [thue_morse(3000), thue_morse(3000, "ba")])
    items = [WORD.findall(raw(r.text)) for r in texts.orderBy("doc_id").collect()]
    got = {r.doc_id: r.n_removed for r in debruijn.removed(texts, Scratch(spark)).collect()}
    assert got == {i: sum(m) for i, m in enumerate(removed_units(items, 35))}
    items = [raw(r.text) for r in texts.orderBy("doc_id").collect()]
    got = {r.doc_id: r.n_removed for r in suffixes.removed(texts, Scratch(spark)).collect()}
    assert got == {i: sum(m) for i, m in enumerate(removed_units(items, suffixes.WINDOW))}


def test_spans_do_not_collide():
    x, y = (np.array([words.U(5 if c == "a" else 9) for c in thue_morse(4096, o)]) for o in ("ab", "ba"))
    ends = np.array([0]), np.array([4096])
    assert words.span_hash(words.prefix_sums(x), *ends) == words.span_hash(words.prefix_sums(y), *ends)
    assert words.piece_hash(x, *ends) != words.piece_hash(y, *ends)
    both = words.eights_of(np.frombuffer(b"0123456789abcdef0123456789abcdef!!", np.uint8))
    got = words.piece_hash(both, np.array([1, 17, 1, 0]), np.array([15, 31, 14, 1]), 8).tolist()
    assert got[0] == got[1] and len(set(got)) == 3


def test_compaction_decides_what_is_removed(spark, monkeypatch):
    rng = random.Random(2)
    passage = prose(rng, 400, 3000)
    texts = [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(5)]
    ranked = debruijn.compacted
    paths = []
    monkeypatch.setattr(debruijn, "compacted", lambda p, scratch: paths.append((p.count(), ranked(p, scratch))) or paths[-1][1])
    assert {r.n_removed for r in debruijn.removed(docs_of(spark, texts), Scratch(spark)).collect()} == {400}
    assert paths[0][0] > 50 and paths[0][1].count() == 5


def test_texts_of_several_slices(spark, monkeypatch):
    from countloom.llm import repeats

    monkeypatch.setattr(repeats, "PIECE", 3000)
    rng = random.Random(8)
    long = prose(rng, 30_000, 5000)
    texts = ["x " + long[70_000:71_000] + " y", long, long[:90_000] + " z", None]
    items = [WORD.findall(raw(t)) for t in texts]
    got = {r.doc_id: r.n_removed for r in debruijn.removed(docs_of(spark, texts), Scratch(spark)).collect()}
    assert got == {i: sum(m) for i, m in enumerate(removed_units(items, 35))}


def test_two_stage_sort():
    rng = random.Random(5)
    for _ in range(200):
        depth, letters = rng.randint(1, 12), bytes(rng.sample(range(256), rng.randint(1, 4)))
        own, n = [], []
        for _ in range(rng.randint(1, 6)):
            n.append(rng.randint(1, 30))
            own.append(bytes(rng.choice(letters) for _ in range(n[-1] + depth - 1)) if rng.random() < 0.8 else letters[:1] * (n[-1] + depth - 1))
        order, t = suffixes.suffix_order(own, np.array(n), depth)
        keys = [bytes((t[p : p + depth] - 1).astype(np.uint8)) for p in order]
        assert keys == sorted(keys) and len(keys) == sum(n)
        count = collections.Counter(o[i : i + depth] for o, k in zip(own, n, strict=True) for i in range(k))
        want = [count[o[i : i + depth]] > 1 for o, k in zip(own, n, strict=True) for i in range(k)]
        assert suffixes.compare(depth)(own, np.array(n)).tolist() == want


def invented(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


TONGUES = {"xa": ["ka", "to", "mi", "ra", "ñu"], "xb": ["sch", "ei", "ung", "ver", "ß"], "xc": ["the", "ing", "on", "er", "st"]}


def test_language(spark):
    rng = random.Random(4)
    rows = [(i, invented(rng, TONGUES[lang], rng.randint(3, 60)), lang) for i in range(600) for lang in [rng.choice(list(TONGUES))]]
    rows += [(900, None, "xa"), (901, "", None), (902, "12 ... —", "xb"), (903, "\U0001f600", None), (904, "kato mira", None), (None, "verung", "xb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = langid.held_out(F.col("doc_id"), 4, 2)
    got = {r.doc_id: r for r in langid.identify(docs, ~held).collect()}
    test = [(i, lang) for i, _, lang in rows if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in test]) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4 and got[904].lang_pred == "xa"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].lang_pred == "xb"


def test_language_backs_off_to_shorter_grams():
    model = langid.fit({"a": [b"kato mira kato tomi"] * 3, "b": [b"verung schei verung eiver"] * 3}, 100, 1000)
    raw_ = "katox zverungz q".encode()
    best, _ = model.score(np.frombuffer(raw_[:5], np.uint8), np.array([0, 5]))
    assert model.languages[best[0]] == "a"
    best, _ = model.score(np.frombuffer(raw_[6:14], np.uint8), np.array([0, 8]))
    assert model.languages[best[0]] == "b"


def test_language_with_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs, F.lit(True)).first().lang_pred == "und"
    assert langid.identify(docs.limit(0), F.lit(True)).isEmpty()


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "SCORES", 2000)  # many groups of texts
    monkeypatch.setattr(langid, "LEAST", 20)
    rng = random.Random(9)
    letters = [chr(0x4E00 + i) for i in range(700)]
    tongues = {f"l{i:02}": letters[i * 8 : i * 8 + 8] for i in range(80)}
    rows = [(0, "x", None)]
    for i, (lang, syllables) in enumerate(tongues.items()):
        rows += [(len(rows) + j, invented(rng, syllables, 12), lang) for j in range(3 if i >= 64 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(True), words=200, grams=200).collect()}
    assert {i for i, _, lang in rows if lang is not None and got[i] != lang} == set()


def toxic_corpus(spark, n=900):
    rng = random.Random(6)
    bad, rows, labels = {"xa": ["zzkato", "zzmira"], "xb": ["qqver", "qqung"], "xc": ["idiot", "scum"]}, [], []
    for i in range(n):
        lang, toxic = rng.choice(list(TONGUES)), int(rng.random() < 0.3)
        w = invented(rng, TONGUES[lang], rng.randint(5, 120)).split()
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w) + 1), rng.choice(bad[lang]))
        rows.append((i, " ".join(w), lang, "s", 0))
        labels.append((i, 1, toxic))
    rows += [(5000, None, None, None, None), (5001, "", "xa", "s", 0), (5002, "!!", "xb", "s", 2)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    learn = ~langid.held_out(F.col("doc_id"), 3, 1)
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(docs.withColumn("toxic_score", F.lit("clash")), labels, learn).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    right = np.mean([(got[i] >= 0.7) == bool(t) for i, t in truth.items()])
    assert right > 0.95 and all(0 <= s <= 1 for s in got.values())
    assert got[5000] == got[5001] == got[5002] < 0.7
    kept = {r.doc_id for r in toxicity.clean(docs, labels).collect()}
    assert {5000, 5001, 5002} <= kept and docs.count() > len(kept)


def test_toxicity_learns_from_all_labelled_texts(spark, monkeypatch):
    """More labelled texts than one task takes: words that few texts hold count, whichever texts they are."""
    docs, labels = toxic_corpus(spark, 600)
    rare = [(10_000 + i, f"fine mild text rareword{i % 12} of these", "xa", "s", 0) for i in range(96)]
    docs = docs.unionByName(spark.createDataFrame(rare, DOCS))
    labels = labels.unionByName(spark.createDataFrame([(i, 1, 1) for i, *_ in rare], labels.schema))
    monkeypatch.setattr(toxicity, "LEARNER", 100_000)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r.toxic_score for r in toxicity.scored(docs, labels, F.lit(True), per_label=10).collect()}
    right = np.mean([(got[i] >= 0.7) == bool(t) for i, t in truth.items()])
    assert right > 0.97 and sum(got[i] >= 0.7 for i, *_ in rare) > 90
    again = {r.doc_id: r.toxic_score for r in toxicity.scored(docs.repartition(7), labels, F.lit(True), per_label=10).collect()}
    assert again == pytest.approx(got, abs=1e-6)


def test_sums_over_learners(spark):
    """Counts of learners are those of all texts in one."""
    docs, labels = toxic_corpus(spark, 60)
    rows = toxicity.labelled(docs, toxicity.marked(labels, F.lit(True)))
    from countloom.llm.common import Scratch

    learners = toxicity.Learners(rows, 5 * toxicity.LEARNER, False, Scratch(spark))
    assert learners.rows.count() > 1
    got, _ = toxicity.summed(learners.each(toxicity.counted, ["xa"], toxicity.PIECES), 3, mean=False)
    every = rows.collect()
    words, first = toxicity.features(np.frombuffer(b"".join(r.text.encode() + b" " for r in every), np.uint8), np.cumsum([0, *(len(r.text.encode()) + 1 for r in every)]))
    assert (got[:, :2].T == toxicity.seen_by_label(words, first, np.array([r.toxic for r in every]))).all()
    xa = np.repeat([r.lang == "xa" for r in every], np.diff(first))
    assert (got[:, 2] == np.bincount(words[xa, 0], minlength=len(got))).all()


def test_settle_gives_native_memory_back(spark, monkeypatch):
    from countloom.llm import common

    seen, real = [], common.trim
    monkeypatch.setattr(common, "trim", lambda s: seen.append(real(s)))
    common.Scratch(spark).settle()
    assert len(seen) == 1 and isinstance(seen[0], bool)


def test_score_looks_at_text_only(spark):
    docs, labels = toxic_corpus(spark, 200)
    a = toxicity.scored(docs, labels, F.lit(True))
    seen = {r.text: r.toxic_score for r in a.collect()}
    rows, count = toxicity.sample(docs, labels, F.lit(True), 3000)
    model = toxicity.build(rows.toArrow(), count, 6000)
    for text in list(seen)[:40]:
        if text:
            s = model.score(model.projected(), np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            assert s[0] == pytest.approx(seen[text], abs=1e-5)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark, 5)
    assert {r.toxic_score for r in toxicity.scored(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), labels, F.lit(True)).isEmpty()


def test_convolution_is_the_plain_one():
    rng = np.random.default_rng(2)
    m = toxicity.Model(rng.normal(size=(sum(toxicity.BUCKETS), toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], np.zeros(18, np.float32), np.ones(18, np.float32), 0.0)
    n = [4, 1, 0, 2, 7]
    first = np.cumsum([0, *n])
    own = rng.integers(0, 1000, (sum(n), 3))
    got = m.respond(m.projected(), own, first)
    e = m.table[own].sum(axis=1)
    for d, size in enumerate(n):
        for t in range(size):
            for i, (w, f) in enumerate(zip(toxicity.WIDTHS, m.filters, strict=True)):
                want = sum(e[first[d] + t + k] @ f[k] for k in range(w) if t + k < size)
                assert np.allclose(got[i * 6 : i * 6 + 6, first[d] + t], want, atol=1e-4)


def test_long_and_repeated_texts_are_learnt(spark):
    """Whole texts of any length, several labels of a document, rows that come twice."""
    rng = random.Random(11)
    rows = [(i, invented(rng, TONGUES["xa"], 20_000), "xa") for i in range(3)] + [(10 + i, invented(rng, TONGUES["xb"], 30), "xb") for i in range(20)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string")
    assert len(rows[0][1]) > 1 << 16
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(True)).collect()}
    assert got == {i: lang for i, _, lang in rows}
    bad = [(i, ("zzbad zzworse " if i % 2 else "fine ") + invented(rng, TONGUES["xc"], 12_000 if i < 6 else 40), "xc") for i in range(200)]
    labels = [(i, 1, i % 2) for i in range(200)] + [(1, 0, 0), (3, 1, 1)]
    docs = spark.createDataFrame(bad + bad[:9], "doc_id long, text string, lang string").withColumn("toxic_score", F.lit("mine"))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows_, count = toxicity.sample(docs, marked, F.lit(True), 3000)
    assert rows_.count() == 209 and count == {0: 100, 1: 100}
    kept = toxicity.clean(docs, marked)
    assert {r.toxic_score for r in kept.collect()} == {"mine"} and kept.columns == docs.columns
