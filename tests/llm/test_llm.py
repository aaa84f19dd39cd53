"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumivox.llm import bpe, decontam, embed_dedup, license_scan, line_dedup, packing, quality, simhash, suffix_tree, warc
from lumivox.llm.common import components, scratch
from lumivox.llm.queries import tokenizer_file

DOC = "doc_id long, text string, lang string, component_id string, n_lines string, score string, ids string"
WORDS = "the of and to alpha beta gamma delta river stone cloud market engine winter paper garden silver copper".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    texts = [text(rng, int(n)) for n in rng.integers(1, 60, 30)]
    texts += [texts[0], texts[1], texts[2] + " extra", None, "", "   ", "\n\n", "x" * 5000, text(rng, 20_000), "a\nb\na\n" + texts[3], "ÄÖ ß 中文 😀 <|endoftext|> end  two"]
    rows = [(k, t, "en", "c", "n", "s", "i") for k, t in enumerate(texts)] + [(3, texts[3], "en", "c", "n", "s", "i"), (None, texts[4], None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(x):
    return (x is None, x or 0)


def test_components_of_paths_stars_and_hubs(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(500, 400), (300, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 160)}, 300: 300, 400: 300, 500: 300}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# 1


def test_warc_round_trip(spark):
    big, small = "é" * 600, "s"
    rows = [(1, "http://a", big), (2, "http://b", big), (9, "http://c\n", big), (3, "u", small), (4, "u", small), (5, None, None), (6, "u", ""), (7, "u", "z" * 100_000), (None, "u", "no id"), (None, "v", big), (None, "w", "y" * 2000), (None, "w", "y" * 2000), (4, "u", small), (9, "http://c", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = html == big and page != 9
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 9 if again else None))
    order = lambda r: (key(r[0]), r[1:4], key(r[4]))
    assert sorted(got, key=order) == sorted(want, key=order)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_zip64_directory_and_payloads(spark, tmp_path):
    import zipfile

    path = str(tmp_path / "many.zip")
    with zipfile.ZipFile(path, "w", allowZip64=True) as z:
        for k in range(70_000):  # more than the plain end record can count
            z.writestr(f"m{k}", b"")
        z.writestr("last", b"payload")
    with open(path, "rb") as f:
        f.seek(0, 2)
        members = warc.directory(f, f.tell())
        assert len(members) == 70_001 and warc.read_member(f, members["last"]) == b"payload"
    with pytest.raises(ValueError):
        with open(__file__, "rb") as f:
            warc.directory(f, 100)
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k}" * 300) for k in range(20)], "page_id long, url string, html string")
    packages = warc.write_packages(pages, scratch(spark, "warc-test"), package_bytes=400)
    assert packages.count() > 2 and packages.agg(F.sum("records")).first()[0] == 20
    back = warc.open_packages(spark, [r.package for r in packages.collect()])
    assert {r.page_id: bytes(r.payload).decode() for r in back.collect()} == {k: f"page {k}" * 300 for k in range(20)}


# 2


def test_classifier_tells_junk_from_prose_and_ignores_held_out_labels(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for k in range(400):
        good = k % 4 != 0
        rows.append((k, text(rng, 40) if good else " ".join(w + "%%%" for w in rng.choice(WORDS, 40)), "en"))
        held = zlib.crc32(str(k).encode()) % 5 == 0
        labels.append((k, int(good) if not held else int(not good)))  # labels of the held-out fold are wrong on purpose
    rows += [(1000, None, "en"), (1001, "", None), (None, text(rng, 30), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    l = spark.createDataFrame(labels + [(5, None), (None, 1), (7, 3)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(d, l).collect()}
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    right = [out[k].predicted == int(k % 4 != 0) for k in range(400)]
    assert np.mean(right) > 0.97
    assert out[1000].score == out[1001].score
    assert all(out[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(400))
    empty = quality.classify(d.limit(0), l)
    assert empty.count() == 0
    assert quality.classify(d.limit(3), l.limit(0)).count() == 3


# 3


def library_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    return t


def test_bpe_equals_the_library(spark, docs):
    t = library_tokenizer()
    got = bpe.digests(docs, tokenizer_file("byte_bpe_50k.json")).collect()
    want = []
    for d, x in pairs(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=lambda r: (key(r[0]), r)) == sorted(want, key=lambda r: (key(r[0]), r))
    assert bpe.digests(docs.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_bpe_on_random_strings_and_fragments():
    c, t = bpe.codec(tokenizer_file("byte_bpe_50k.json")), library_tokenizer()
    rng = np.random.default_rng(2)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "'s", "'ll", "1", "½", "中", "😀", "​", "\x85", "\x1c", "\xa0", "　", "!", "<|endoftext|>", "<|end", "\0", "ǆ", "²", "Ⅷ"]
    for _ in range(3000):
        s = "".join(rng.choice(alphabet, rng.integers(0, 25)))
        ids = t.encode(s, add_special_tokens=False).ids
        assert c.encode(s).tolist() == ids and c.decode(ids) == t.decode(ids, skip_special_tokens=False)
    words = ["".join(chr(x) for x in rng.integers(97, 123, n)) for n in rng.integers(1, 20, 2000)]
    for w in words:
        raw = w.encode()
        assert list(c.encode_fragment(raw)) == c.merge(raw) == [i for f in c.fragments(raw) for i in c.merge(f)]


def test_bpe_cuts_at_pairs_in_no_token_and_fragments_are_independent():
    c, t = bpe.codec(tokenizer_file("byte_bpe_50k.json")), library_tokenizer()
    rng = np.random.default_rng(15)
    inside = {p for x in c.token for p in zip(x, x[1:])}
    for s in ["one two, three.\n\nfour  five 'tis it's !'s " + text(rng, 50), "été à l'école\u3000\u3000中文 ½ x", "x" * 3000 + " y" * 50]:
        raw = s.encode()
        parts = c._cuts(raw)
        assert b"".join(parts) == raw and len(parts) > 5
        assert all((p[-1], q[0]) not in inside for p, q in zip(parts, parts[1:]))
        assert [i for p in parts for i in t.encode(p.decode(), add_special_tokens=False).ids] == t.encode(s, add_special_tokens=False).ids == c.encode(s).tolist()
        for piece in c.split(s):
            fragments = c.fragments(piece.encode())
            assert [i for f in fragments for i in c.encode_fragment(f)] == c.merge(piece.encode())
            assert all((p[-1], q[0]) not in inside for p, q in zip(fragments, fragments[1:]))


# 4


def items(spark):
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(f"{w}{rng.integers(0, 30)}" for w in rng.choice(WORDS, rng.integers(9, 40)))) for k in range(60)]
    return rows + [(60, "Which of the two rivers is longer? alpha1 beta2 gamma3 delta4 river5 stone6"), (61, "one two"), (None, "null id item text here now then"), (62, None), (63, "")]


def test_decontamination_finds_every_verified_overlap(spark):
    rng = np.random.default_rng(10)
    its = items(spark)
    rows = []
    for k in range(200):
        w = [f"{x}{rng.integers(0, 30)}" for x in rng.choice(WORDS, 150)]
        if k % 3 == 0:
            own = its[k % 61][1].split()
            drop = int(rng.integers(0, 1 + len(own) // 4))
            at = int(rng.integers(0, 140))
            w[at:at] = own[drop:] if k % 2 else own[: len(own) - drop]
        rows.append((k, " ".join(w).upper() if k % 5 == 0 else " ".join(w), 1.0))
    rows += [(900, its[60][1].split("?")[0] + "?", 1.0), (901, None, 1.0), (902, "", 1.0), (903, "so ONE, two.", 1.0), (None, its[5][1], 1.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, bm25 double")
    bench = spark.createDataFrame(its, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontam.find(d, bench).collect()]
    n, longest = 5, max(len(decontam.words(t)) for i, t in its if i is not None)
    want = []
    step = max(longest, 32)
    for k, t, _ in rows:
        w = decontam.words(t)
        for i, x in its:
            if i is None or not decontam.words(x):
                continue
            q, a = decontam.question_answer(x)
            for s in range(0, max(1, len(w) - step), step):
                p = w[s : s + 2 * step]
                sh = decontam.shingles(p, n)
                if decontam.overlap(q, sh, p, n) >= 0.8 and (not a or decontam.overlap(a, sh, p, n) >= 0.8):
                    want.append((k, i))
                    break
    assert sorted(got, key=lambda r: (key(r[0]), r[1])) == sorted(want, key=lambda r: (key(r[0]), r[1]))
    assert (900, 60) not in got and (None, 5) in got
    few = [(r.doc_id, r.item_id) for r in decontam.find(d, bench, per_block=7).collect()]
    assert sorted(few, key=lambda r: (key(r[0]), r[1])) == sorted(got, key=lambda r: (key(r[0]), r[1]))
    assert decontam.find(d, bench.limit(0)).count() == 0 and decontam.find(d.limit(0), bench).count() == 0


def test_decontamination_without_the_answer_label(spark):
    its = [(1, "What is the capital of France?\nAnswer: Paris"), (2, "Name the longest of the rivers here\nA: the blue one")]
    filler = " ".join(f"filler{k}" for k in range(40))
    rows = [(1, f"{filler} What is the capital of France? Paris {filler}"), (2, f"{filler} name the longest of the rivers here: the blue one {filler}"), (3, f"{filler} What is the capital of France? {filler}")]
    rows += [(k + 10, f"{filler} {t} {filler}") for k, t in its]
    d, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(its, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find(d, bench).collect()) == [(1, 1), (2, 2), (11, 1), (12, 2)]


def test_decontamination_wherever_a_passage_stands(spark):
    """Copies with inserted words, or with text between question and answer, at every offset, and whatever other items there are."""
    rng = np.random.default_rng(12)
    long = [f"long{k}" for k in range(51)]
    its = [(1, " ".join(long)), (2, "Which of these towns lies on the coast? it is the town of grey towers")] + [(k, " ".join(f"o{k}w{i}" for i in range(9 * k))) for k in (3, 9)]
    copies = [" ".join(long[:17] + ["and"] * 14 + long[17:34] + ["so"] * 14 + long[34:]), its[1][1].replace("? ", "? " + "between " * 40)]
    rows = [(100 * k + at, " ".join(f"f{rng.integers(0, 999)}" for _ in range(7 * at)) + " " + c + " tail" * 90) for k, c in enumerate(copies, 1) for at in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for bench, per_block in ((its, 20_000), (its[:2], 20_000), (its, 1)):
        got = sorted((r.doc_id, r.item_id) for r in decontam.find(d, spark.createDataFrame(bench, "item_id long, text string"), per_block=per_block).collect())
        assert got == [(k, k // 100) for k, _ in rows], len(got)


def test_decontamination_of_long_and_repeated_texts(spark):
    rng = np.random.default_rng(17)
    its = [(1, "Which of these rivers is the longest one in the north? the grey one of course my friend"), (1, "Which of these rivers is the longest one in the north? the grey one of course my friend"), (2, " ".join(f"z{k}" for k in range(500)))]
    long = text(rng, 60_000) + " " + its[0][1] + " " + text(rng, 60_000) + " " + its[2][1]
    d = spark.createDataFrame([(1, long), (2, its[0][1]), (2, its[0][1]), (3, its[0][1].split("?")[0] + "? another"), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.passage, r.question_overlap) for r in decontam.find(d, spark.createDataFrame(its, "item_id long, text string")).collect())
    assert [r[:2] for r in got] == [(1, 1), (1, 2), (2, 1), (2, 1)] and got[0][2] <= 60_000 <= got[0][2] + 64 and all(r[3] == 1 for r in got)


def test_pivot_step_looks_at_bounded_runs_of_marked_postings(monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    common = ["the", "of", "and", "to"]
    item = lambda: " ".join(rng.choice(common if rng.random() < 0.5 else vocabulary) for _ in range(40))
    items = [(k, item()) for k in range(2000)]
    df = Counter(t for _, x in items for t in set(x.split()))
    index = decontam.Index(items, df, len(items), 40.0, 0.8, 5)
    texts = [(" ".join(rng.choice(common + vocabulary[:50], 300)) + " " + items[k][1] + " " + item()).split() for k in range(25)]
    asked, real = [], decontam.Index._reached
    monkeypatch.setattr(decontam.Index, "_reached", lambda self, chunk, term, count, *rest: asked.append((int(count.sum()), rest[-1] - rest[-2])) or real(self, chunk, term, count, *rest))
    whole = index.pivot_step(texts, 80)
    every = sum(len(index.post[index.term[t]]) for w in texts for c in range(0, len(w), 80) for t in set(w[c : c + 80]) if t in index.term)
    assert sum(n for n, _ in asked) < 0.2 * every  # the common words' postings aren't expanded at all
    asked.clear()
    monkeypatch.setattr(decontam, "EXPANDED", 500)
    assert index.pivot_step(texts, 80) == whole and len(asked) > 5 and all(n <= 500 or passages == 1 for n, passages in asked)
    assert all(any(k in {i for i, _ in index.search(sorted({index.term[x] for x in texts[k][p * 80 : p * 80 + 160] if x in index.term}))} for p in whole[k]) for k in range(25))


def test_pivot_step_loses_no_passage_that_reaches_the_threshold(spark):
    index = decontam.loaded(decontam.indexes(spark.createDataFrame(items(spark), "item_id long, text string"), 0.8, 5, 1000)[0][0])
    rng, step = np.random.default_rng(18), 40
    texts = []
    for _ in range(80):
        own = index.parts[rng.integers(len(index.ids))]
        w = [f"{x}{rng.integers(0, 30)}" for x in rng.choice(WORDS, 150)]
        w[int(rng.integers(0, 100)) : 0] = own[0][: int(rng.integers(1, len(own[0]) + 1))] + own[1]
        texts.append(w)
    found, reached = index.pivot_step(texts, step), 0
    for k, w in enumerate(texts):
        for p in range(-(-len(w) // step)):
            if index.search(sorted({index.term[x] for x in w[p * step : (p + 2) * step] if x in index.term})):
                reached += 1
                assert p in found.get(k, [])
    assert reached > 20


def test_block_max_search_equals_full_scores(spark):
    index = decontam.loaded(decontam.indexes(spark.createDataFrame(items(spark), "item_id long, text string"), 0.8, 5, 1000)[0][0])
    rng = np.random.default_rng(4)
    for _ in range(300):
        own = [index.term[w] for w in set(index.parts[rng.integers(len(index.ids))][0])]
        terms = sorted({*rng.choice(own, rng.integers(1, len(own) + 1)).tolist(), *rng.integers(0, len(index.post), 60).tolist()})
        full = Counter()
        for t in terms:
            for k, x in zip(index.post[t], index.impact[t]):
                full[k] += x
        assert {k for k, x in full.items() if x >= 1} == {k for k, _ in index.search(terms)}


# 5


def test_suffix_tree_base_score_and_model(spark, docs):
    rows = pairs(docs)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tok = lambda x: [*re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate({i: i + 32 for i in range(65, 91)})), None]
    c = Counter(w for d, x in rows if not held(d) for w in tok(x))
    n, v = sum(c.values()), len(c)
    got = suffix_tree.score_documents(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, x in rows:
        texts.setdefault(d, x)
    for r in got:
        w = tok(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert suffix_tree.score_documents(docs.limit(0)).count() == 0


def test_suffix_tree_learns_contexts_and_sums_to_one(spark):
    rng = np.random.default_rng(0)
    chain = {"a": ["b"] * 9 + ["c"], "b": ["a"] * 5 + ["c"] * 5, "c": ["a", "b", "c"]}
    seqs = []
    for _ in range(300):
        w = ["a"]
        while len(w) < 30:
            w.append(chain[w[-1]][rng.integers(len(chain[w[-1]]))])
        seqs.append(" ".join(w))
    train = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "doc_id long, text string")
    tree = suffix_tree.learn(train)
    assert len(tree.keys) >= 2
    one = lambda x: suffix_tree.score(spark.createDataFrame([(1, x)], "doc_id long, text string"), tree).first().score
    assert one("a b a b a b") > one("a c a c a c") + 1
    # the tree by plain counting: which contexts it keeps, from their hashes, and what follows them
    o, after, root = suffix_tree.Options(), {}, Counter()
    for x in seqs:
        w = [*x.split(), None]
        for i, y in enumerate(w):
            root[y] += 1
            for d in range(1, min(i, o.depth) + 1):
                after.setdefault(tuple(w[i - d : i]), Counter())[y] += 1
    hashed = lambda c: int(functools.reduce(lambda h, w: suffix_tree.mix(h, np.array([xxhash.xxh64_intdigest(w.encode())], np.uint64)), reversed(c), np.zeros(1, np.uint64))[0])
    known = set(tree.keys.tolist())
    kept = {c for c in after if hashed(c) in known}
    assert len(kept) == len(known) and ("a",) in kept and all(c[1:] in kept or len(c) == 1 for c in kept)
    n, unseen = sum(root.values()), (sum(v == 1 for v in root.values()) + 0.5) / (sum(root.values()) + 1)

    def chance(before, y):
        p = (1 - unseen) * root[y] / n if root[y] else unseen
        for d in range(1, o.depth + 1):
            c = tuple(before[-d:])
            if len(c) < d or c not in kept:
                break
            own = after[c]
            p = (max(own[y] - o.discount, 0) + o.discount * len(own) * p) / sum(own.values())
        return p

    for x in ("a b a b a b", "a c a c zzz a", "", "c c b a", seqs[0]):
        w = [*x.split(), None]
        assert one(x) == pytest.approx(sum(math.log10(chance(w[:i], y)) for i, y in enumerate(w)))
    for before in ([], ["a"], ["a", "b"], ["c", "a", "b"], ["zzz"]):
        assert sum(chance(before, y) for y in [*root, "zzz"]) == pytest.approx(1)


def test_suffix_tree_of_real_texts_beats_its_root(spark):
    from dataclasses import replace

    from lumivox.llm.common import held_out, table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    train = docs.where(~held_out(F.col("doc_id"), 7, 2))
    tree = suffix_tree.learn(train)
    assert tree.contexts.where("n < 50").isEmpty() and tree.contexts.count() > 300
    mean = lambda o: suffix_tree.score_documents(docs, o).where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert mean(suffix_tree.Options()) > mean(replace(suffix_tree.Options(), least=1 << 40)) + 0.05


def test_suffix_tree_filter_is_bounded_and_never_misses(spark):
    from dataclasses import replace

    keys = np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    df = spark.createDataFrame([(bytearray(suffix_tree.packed_keys(k)),) for k in np.array_split(keys, 5)], "keys binary")
    for bits in (1 << 27, 1 << 16):  # with room, and with none
        f = suffix_tree.filter_of(df, len(keys), replace(suffix_tree.Options(), filter_bits=bits))
        assert f.bits <= bits and f(keys).all()
    assert suffix_tree.filter_of(df, len(keys), suffix_tree.Options())(keys + np.uint64(1)).mean() < 0.05


def test_suffix_tree_pairs_take_few_bytes_and_come_back(spark):
    rng = np.random.default_rng(4)
    h, symbols = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)[rng.zipf(1.3, 200_000) % 2000], rng.zipf(1.2, 200_000) % 100_000 + suffix_tree.FIRST
    for times in (10, 5 << 18):  # whole contexts, and in shares
        distinct, shares, code = suffix_tree.pairs(h, symbols, np.full(len(h), times))
        blocks = suffix_tree.pair_blocks(distinct, shares, *np.unique(code, return_counts=True), 4)
        contexts, runs, back = suffix_tree.unpacked_pairs(blocks)
        n = np.concatenate([suffix_tree.unpacked(c) for c in blocks["counts"]])
        assert Counter(dict(zip(zip(np.repeat(contexts, runs).tolist(), back.tolist()), n.tolist()))) == Counter(zip(h.tolist(), symbols.tolist()))
        assert blocks[["contexts", "runs", "symbols", "counts"]].map(len).to_numpy().sum() < 5 * len(n)  # two hashes took 14 or more
    ids = [None if k % 3 == 0 else (1 << 60) + k for k in range(600)]
    df = spark.createDataFrame([(d, "a b") for d in ids], "doc_id long, text string")
    assert Counter(r.doc_id for r in suffix_tree.score_documents(df).select("doc_id").collect()) == Counter(ids)


# 6


def wrapped(x, width):
    out = [""]
    for w in x.split():
        if len(out[-1]) + len(w) >= width:
            out.append("")
        out[-1] += f" {w}" if out[-1] else w
    return "\n".join(out)


def test_license_notices_in_any_place(spark):
    code = "\n".join(f"def f{k}(x{k}): return x{k} + {k}" for k in range(60))
    mit = license_scan.MIT
    rows = [(1, "some prose here\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "released under the  MIT licence."), (3, "Released under the MIT License."), (4, None), (5, ""), (6, "licensed under something else entirely, not at all")]
    rows += [(7, f"Copyright (c) 2020 Someone\n\n{wrapped(mit, 79)}\n\n{code}"), (8, "Licensed under the MIT License. See LICENSE for details."), (9, f"{code}\n# This work is licensed under a Creative Commons\n# Attribution 4.0 International License.\n{code}")]
    rows += [(10, "Released under the MIT License.\n" * 3), (10, "Released under the MIT License.\n" * 3), (None, "x\n" + license_scan.TEMPLATES[5][1] + " and a few more"), (11, "word " * 30_000 + "\nReleased under the MIT License.\n" + "of the " * 30_000)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, row int")
    got = sorted(((r.doc_id, r.first_line, r.last_line, r.license) for r in license_scan.scan(d).collect()), key=lambda r: (key(r[0]), r))
    lines = wrapped(mit, 79).count("\n") + 1
    want = [(1, 1, 1, "Apache-2.0"), (3, 0, 0, "MIT"), (7, 2, 1 + lines, "MIT"), (8, 0, 0, "MIT"), (9, 60, 61, "CC-BY-4.0")]
    want += [(10, k, k, "MIT") for k in (0, 0, 1, 1, 2, 2)] + [(11, 1, 1, "MIT"), (None, 1, 1, "MIT")]
    assert got == want
    assert license_scan.scan(d.limit(0)).count() == 0
    for n in range(1, 200):  # the bounds admit exactly the sizes that can reach the threshold
        low, high = license_scan.size_bounds(n, 0.8)
        assert [m for m in range(1, 400) if 2 * min(n, m) / (n + m) >= 0.8 - 1e-12] == list(range(low, high + 1))


def test_license_scan_equals_its_sql_on_mangled_texts(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(14)
    rows = []
    for k in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            w = license_scan.TEMPLATES[int(rng.integers(len(license_scan.TEMPLATES)))][1].split()
            keep = rng.random(len(w)) > rng.choice([0, 0.03, 0.1])
            parts += [wrapped(" ".join(x for x, y in zip(w, keep) if y), int(rng.integers(30, 200))), *[text(rng, 12)] * int(rng.integers(0, 2))]
        rows.append((k, str(rng.choice(["\n", " ", "\n\n", ". "])).join(parts)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    d.write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = sorted(c.execute(license_scan.scan_sql()).fetchall())
    assert sorted(map(tuple, license_scan.scan(d).collect())) == want and len(want) > 100


# 7


def brute_components(fp, bits):
    root = list(range(len(fp)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def test_simhash_components(spark, docs):
    rows = pairs(docs)
    got = simhash.near_duplicates(docs).collect()
    fp = [simhash.fingerprint(x) for _, x in rows]
    groups = brute_components(fp, 2)
    least = {}
    for (d, _), g in zip(rows, groups):
        least[g] = d if least.get(g) is None else least[g] if d is None else min(least[g], d)
    want = sorted(((d, f"{f:016x}", least[g]) for (d, _), f, g in zip(rows, fp, groups)), key=lambda r: (key(r[0]), r[1]))
    assert sorted(map(tuple, got), key=lambda r: (key(r[0]), r[1])) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_by_definition():
    w = "Ab cD ab\tCD ef gh".split()
    sh = [" ".join(x).lower() for x in zip(w, w[1:], w[2:])]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    assert simhash.fingerprint("Ab cD ab\tCD ef gh") == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("One") == xxhash.xxh64_intdigest(b"one", 42) and simhash.fingerprint("") == 0


@pytest.mark.parametrize("crowd", [64, 2])
def test_simhash_links_random_fingerprints(spark, crowd):
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fp = list({*base, *(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in base for _ in range(6))})
    signed = [f - (1 << 64) if f >> 63 else f for f in fp]
    df = spark.createDataFrame([(s, k) for k, s in enumerate(signed)], "fp long, least long")
    edges = {(r.a, r.b) for r in simhash.links(df, 2, crowd).collect()}
    assert all((a ^ b).bit_count() <= 2 or ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
    index = {s: k for k, s in enumerate(signed)}
    root = list(range(len(fp)))
    for _ in range(len(fp)):
        for a, b in edges:
            m = min(root[index[a]], root[index[b]])
            root[index[a]] = root[index[b]] = m
    assert len(set(map(lambda k: root[k], range(len(fp))))) == len(set(brute_components(fp, 2)))


def test_similar_documents_by_exact_shingles(spark):
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts = [[word() for _ in range(80)] for _ in range(60)]
    for t in texts[:40]:
        for edits in (1, 2, 3, 6):
            c = list(t)
            for k in rng.integers(0, 80, edits):
                c[k] = word()
            texts.append(c)
    rows = [(k, " ".join(t), "x") for k, t in enumerate(texts)] + [(900, "", "x"), (901, None, "x"), (902, "one two", "x"), (903, "One  two", "x"), (None, "lost", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(d).collect()}
    sets = {k: set(simhash.shingle_hashes(t, 5).tolist()) for k, t, _ in rows if k is not None}
    true = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    together = sum(got[a] == got[b] for a, b in true)
    assert together >= 0.9 * len(true) and len(true) > 40
    root = dict.fromkeys(sets)
    for k in root:
        root[k] = k
    for _ in range(8):
        for a, b in true:
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[k] == root[c] for k, c in got.items())  # nothing unlike is merged
    assert simhash.similar_documents(d.limit(0)).count() == 0


def test_similar_documents_in_a_crowd_of_one_template(spark):
    """Pages of a template are unlike each other at 0.7 to 0.79, with true pairs among them: no crowd may hide those."""
    rng = np.random.default_rng(22)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    template = [word() for _ in range(180)]
    pages = [template + [word() for _ in range(28)] for _ in range(420)]
    pages += [p[:-6] + [word() for _ in range(6)] for p in pages[:40]]
    sets = [set(simhash.shingle_hashes(" ".join(p), 5).tolist()) for p in pages]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    true = [(a, b) for a in range(len(sets)) for b in range(a) if like(a, b) >= 0.8]
    assert len(true) == 40 and 0.7 < like(100, 200) < 0.8
    d = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(pages)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(d).collect()}
    assert sum(got[a] == got[b] for a, b in true) >= 39
    assert all(got[k] == min([k] + [b for a, b in true if a == k]) or k < 420 for k in got)
    assert len(set(got.values())) >= len(pages) - 40  # nothing unlike is merged


# 8


def linked_by_brute_force(x):
    """n_links and component by row of x."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(x))])
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


@pytest.mark.parametrize("blocks", [(1024, 8192), (16, 64)])
def test_embedding_links_and_recall(spark, blocks):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 32))
    x = np.vstack([base, base[:50] + 0.1 * rng.normal(size=(50, 32)), base[:40] * 2, np.repeat(base[:1], 30, axis=0), base[1] + 0.15 * rng.normal(size=(40, 32))]).astype(np.float32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    bad = [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [None] + [1.0] * 31, 1), (1004, [float("inf")] + [1.0] * 31, 1), (1006, [], 1), (None, rows[0][1], 1)]
    # vectors link with those of their own width, be it one component; a repeated vec_id keeps its rows
    other = [(2000, [1.0], 1), (2001, [7.0], 1), (2002, [-1.0], 1), (2003, [1.0, 2.0, 3.0], 1), (2004, [1.0, 2.0, 3.1], 1), (2005, [3.0, -2.0, 0.0], 1), (2006, [5.0, 5.0], 1), (2006, [5.0, 5.0], 1)]
    df = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<float>, n_links int")
    out = embed_dedup.link(df, 0.9, embed_dedup.Options(cell=20, queries=100, data_block=blocks[0], query_block=blocks[1])).collect()
    got = {r.vec_id: r for r in out}
    assert len(out) == len(rows) + len(bad) + len(other)
    true, label = linked_by_brute_force(x)
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    if found.sum() == true.sum():
        assert [got[k].component_id for k in range(len(x))] == label.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for k, r in got.items() if k is not None)
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in (1000, 1001, 1002, 1003, 1004, 1006)) and got[None].n_links == 0
    assert {k: (got[k].n_links, got[k].component_id) for k in range(2000, 2007)} == {2000: (1, 2000), 2001: (1, 2000), 2002: (0, 2002), 2003: (1, 2003), 2004: (1, 2003), 2005: (0, 2005), 2006: (1, 2006)}
    assert embed_dedup.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [300, 1500, 6000])
def test_embedding_recall_as_the_grid_grows(spark, n):
    """Links that cross cells, in pairs of which a sample holds hardly any."""
    rng = np.random.default_rng(31)
    base = rng.normal(size=(n // 2, 32))
    x = np.vstack([base, base + 0.42 * rng.normal(size=base.shape)])
    want, _ = linked_by_brute_force(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    o = embed_dedup.Options(cell=100, queries=300)
    assert o.codes(n) ** 2 >= n / 100
    got = sum(r.n_links for r in embed_dedup.link(df, 0.9, o).collect())
    assert 0.95 * want.sum() <= got <= want.sum(), (got, want.sum())


def test_multi_sequence_visits_cells_in_order():
    rng = np.random.default_rng(16)
    for k1, k2, n in ((7, 5, 35), (7, 5, 9), (1, 6, 4), (30, 40, 200)):
        d1, d2 = rng.random((20, k1)), rng.random((20, k2))
        a, b = embed_dedup.multi_sequence(d1, d2, n)
        for k in range(20):
            every = np.sort((d1[k][:, None] + d2[k][None, :]).ravel())[:n]
            assert np.allclose(d1[k, a[k]] + d2[k, b[k]], every) and len(set(zip(a[k], b[k]))) == n
    x = rng.normal(size=(60, 8))
    index = embed_dedup.fit(x / np.linalg.norm(x, axis=1)[:, None], 5)
    order = index.visited(x[:10])
    assert all(index.ranks(np.repeat(x[k : k + 1], 25, 0), order[k]).tolist() == list(range(1, 26)) for k in range(10))


def test_visits_follow_the_groups_that_need_most():
    rng = np.random.default_rng(31)
    u = rng.normal(size=(30, 32))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q = np.vstack([np.tile(u[:1], (300, 1)), u[1:21]])
    ranks = [(k, 1) for k in range(300)] + [(k, 7) for k in range(300, 320)]
    assert embed_dedup.visits_for(ranks, q, 256, 0.9, embed_dedup.Options(spare=0)) == 7
    assert embed_dedup.visits_for([], q, 256, 0.9) == 256


def test_vectors_without_neighbours_dont_visit_all_cells():
    rng = np.random.default_rng(12)
    work = []
    for n in (6000, 24_000):
        x = rng.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
        o = embed_dedup.Options(cell=64)
        index = embed_dedup.fit(x[:4000], o.codes(n), o)
        q, cells = x[-1000:], index.visits
        index.visits = embed_dedup.visits_for(embed_dedup.made_ranks(index, q, 0.9, o), q, cells, 0.9, o)
        partner = 0.9 * q + np.sqrt(0.19) * (lambda z: z / np.linalg.norm(z, axis=1)[:, None])((lambda z: z - (z * q).sum(1)[:, None] * q)(rng.normal(size=q.shape)))
        found = (index.visited(q) == index.own(partner)[:, None]).any(1).mean()
        assert index.visits < cells and found > 0.98
        work.append(index.visits / cells)
    assert work[1] < 0.8 * work[0]  # a smaller share of more cells


# 9


def test_best_fit_and_free_space():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 65, 60).tolist()
        row, at, rows = packing.best_fit(lengths, 64)
        used = np.zeros((rows, 64), int)
        for n, r, a in zip(lengths, row, at):
            used[r, a : a + n] += 1
        assert used.max() == 1 and used.sum() == sum(lengths)
        free: list[int] = []
        for n in sorted(lengths, reverse=True):  # the rule, by brute force
            fits = [k for k, f in enumerate(free) if f >= n]
            k = min(fits, key=lambda k: free[k]) if fits else len(free)
            if k == len(free):
                free.append(64)
            free[k] -= n
        assert len(free) == rows


def test_packing_is_lossless(spark, docs):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    manifest = packing.pack(docs, path, scratch(spark, "pack-test"), length=64, group_tokens=3000)
    assert manifest.where("shard is not null").select("shard").distinct().count() > 1
    got: dict = {}
    for r in packing.unpack(manifest).collect():
        got.setdefault((r.doc_id, r.pack.split("-")[0]), []).append((r.first_token, r.segment, r.ids))
    enc = packing.ranked(path, bpe.PATTERN)
    want = Counter((d, tuple(enc.encode_ordinary(x or ""))) for d, x in pairs(docs) if x)
    total = sum(len(i) for rows in got.values() for _, _, i in rows)
    assert total == sum(len(k[1]) * c for k, c in want.items())
    once = {d for d, c in Counter(d for d, x in pairs(docs) if x).items() if c == 1}
    for (d, _), rows in got.items():
        if d in once:
            assert (d, tuple(t for _, _, ids in sorted(rows) for t in ids)) in want
    assert manifest.where("n_tokens = 0").count() == 2
    assert packing.packed_digests(docs.limit(0), path).count() == 0


# 10


def kept_lines(rows, least=8):
    """(doc_id, line) of the lines with words that stay."""
    first, order = {}, []
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, l in enumerate((x or "").split("\n")) if x is not None else ():
            w = tuple(y for y in re.split(r"[ \t\x0b\f\r]+", l.lower()) if y)
            if w and w not in first:
                first[w] = (d, k)
                order.append(w)
    near = lambda a, b: len(a) == len(b) and sum(p != q for p, q in zip(a, b)) <= 1 or abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b))))
    return {first[w] for k, w in enumerate(order) if not (len(w) >= least and any(len(o) >= least and near(w, o) for o in order[:k]))}


def without_lines(d, x, kept):
    return None if x is None else "\n".join(l for k, l in enumerate(x.split("\n")) if not l.strip(" \t\x0b\f\r") or (d, k) in kept)


def brute_lines(rows):
    kept = kept_lines(rows)
    return {d: without_lines(d, x, kept) for d, x in rows}


@pytest.mark.parametrize("bits", [1 << 27, 1])
def test_line_dedup_equals_brute_force(spark, bits):
    rng = np.random.default_rng(12)
    lines = [text(rng, int(n)) for n in rng.integers(1, 14, 80)]
    for l in lines[:60]:
        w = l.split()
        k = int(rng.integers(len(w)))
        lines += [" ".join(w[:k] + ["changed"] + w[k + 1 :]), " ".join(w[:k] + w[k + 1 :]), " ".join(w[:k] + ["more"] + w[k:]), l.upper().replace(" ", "  ")]
    lines += ["", "   ", "same hot line that stands very often in these texts"] * 20
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[9 * k : 9 * k + 9])) for k in range(len(lines) // 9)] + [(None, lines[0] + "\nnull first"), (500, None), (501, ""), (502, "w " * 3000)]
    d = spark.createDataFrame([(*r, "n", 7) for r in rows], "doc_id long, text string, n_lines string, flags int")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d, line_dedup.Options(filter_bits=bits)).collect()}
    assert {k: r.text for k, r in got.items()} == brute_lines(rows)
    assert got[500].n_lines == 0 and got[501].n_lines == 1 and sum(r.n_removed for r in got.values()) > 60
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


# the pipeline


def brute_pipeline(spark, rows, labels_at, items):
    """(doc_id, n_tokens, digest of ids) of the documents that five plain stages keep; rows: (doc_id, text)."""
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels_at)
    rows = [r for r in rows if plain_score(model, r[1]) >= 0.3]
    kept = kept_lines(rows)
    rows = [(d, x, without_lines(d, x, kept)) for d, x in rows]
    rows = [(d, x) for d, old, x in rows if x == old or x.strip()]
    sets = {d: frozenset(simhash.shingle_hashes(x, 5).tolist()) for d, x in rows if d is not None}
    root = {d: d for d in sets}
    while True:
        new = {a: min(root[b] for b in sets if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) for a in sets}
        if new == root:
            break
        root = new
    rows = [(d, x) for d, x in dict.fromkeys(r for r in rows if r[0] is not None) if root[d] == d] + [r for r in rows if r[0] is None]
    parts = [[p for p in decontam.question_answer(t) if p] for _, t in items]
    holds = lambda x: any(decontam.best_run(p, decontam.words(x), decontam.passage_words(sum(map(len, p))), 0.8, 5) for p in parts)
    rows = [(d, x) for d, x in rows if not holds(x)]
    t = library_tokenizer()
    ids = [(d, t.encode(x or "", add_special_tokens=False).ids) for d, x in rows]
    return Counter((d, len(i), tuple(i)) for d, i in ids)


def plain_score(model, x):
    """The classifier's score feature by feature, without caches or arrays."""
    w = (x or "").split()
    o, ids = model.options, []
    for k, word in enumerate(w):
        marked = f"<{word}>"
        grams = [f" {word}", *(marked[i : i + n] for n in range(o.shortest, o.longest + 1) for i in range(len(marked) - n + 1))]
        ids += [zlib.crc32(g.encode()) % o.buckets for g in grams]
        if k:
            a, b = (zlib.crc32(y.encode()) for y in (w[k - 1], word))
            ids.append(0 if a == b else (a * 0x9E3779B1 + b) % (1 << 64) % (o.buckets - 1) + 1)
    return 1 / (1 + math.exp(-(model.bias + sum(model.weight[i] for i in ids) / max(1, len(ids)))))


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng = np.random.default_rng(19)
    prose = [" ".join(rng.permutation(base[k][1].split())) for k in range(60) if base[k][1]]
    words = lambda k: prose[k].split()
    edge = [(9000, None), (9001, ""), (9002, "  \n "), (9003, prose[0]), (9004, " ".join([*words(0)[:-3], "changed"])), (9005, prose[1]), (9005, prose[1]), (9006, f"{prose[2]}\n{items[0][1]}\n{prose[3]}")]
    edge += [(None, f"{prose[4]} {items[1][1]}"), (None, prose[5]), (9007, " ".join(prose[6:30])), (9008, f"{prose[30]}\n{prose[0]}")]
    rows = base + edge
    clash = "doc_id long, text string, score string, n_lines int, component_id long, ids string, n_chars long"
    spark.createDataFrame([(d, x, "s", 3, 4, "i", 5) for d, x in rows], clash).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    got = Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in P.run(spark, str(tmp_path)).collect())
    want = brute_pipeline(spark, rows, spark.read.parquet(f"{sf}/labels.parquet"), items)
    assert got == want and 100 < sum(got.values()) < len(rows)
    kept = {d for d, *_ in got}
    assert 9003 in kept or 9004 in kept
    assert not kept >= {9003, 9004} and 9006 not in kept
    made = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES[:-1]:  # columns that an operator would add itself stay as they were
        out = stage(spark, made, str(tmp_path))
        assert out.columns == made.columns
        assert {(r.score, r.n_lines, r.component_id, r.ids) for r in out.collect()} == {("s", 3, 4, "i")}
        assert stage(spark, made.limit(0), str(tmp_path)).count() == 0


def test_scores_of_the_classifier_feature_by_feature(spark, docs):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(d, labels)
    rows = pairs(docs.union(docs.limit(2)))
    got = [(r.doc_id, r.s) for r in quality.score(docs.union(docs.limit(2)), model, to="s").collect()]
    assert len(got) == len(rows)
    want = {}
    for i, x in rows:
        want.setdefault(i, set()).add(round(plain_score(model, x), 9))
    assert all(round(s, 9) in want[i] for i, s in got)
    scored = quality.classify(d, labels).join(labels, "doc_id").where("held_out and quality is not null").select("predicted", "quality", "score").collect()
    assert len(scored) > 40 and np.mean([r.predicted == r.quality for r in scored]) > 0.97


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "bpe"]
    rng = np.random.default_rng(3)
    unlike = ["".join(rng.choice(list("bcdfghklmnprst"), 4)) + "a" for _ in range(3000)]
    plain = [(k, " ".join(unlike[40 * k : 40 * k + 40]), "en", "s", 200) for k in range(30)]
    near = [(100, plain[0][1], "en", "s", 200), (101, "   " + plain[1][1].upper(), "en", "s", 200)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    dirty = [(200, plain[2][1] + " " + item, "en", "s", 1)]
    d = spark.createDataFrame(plain + near + dirty, docs.schema)
    for name, stage in P.STAGES[1:-1]:
        out = stage(spark, d, sf)
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.collect()}
        clean = {k for k in range(30)} - ({2} if name == "line_dedup" else set())
        assert clean <= ids, name
        assert not ids & {"line_dedup": {100, 101}, "near_dedup": {100, 101}, "decontamination": {200}}[name]
    whole = P.run(spark, sf)
    assert 0 < whole.count() < docs.count() and whole.columns == ["doc_id", "ids", "n_tokens"]


def test_anchors_and_salted_nodes_are_not_broadcast(spark):
    from lumivox.llm.common import _with_least

    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    edges = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    # sixty rows a fingerprint and eight a node, which Spark takes for one
    for df in (simhash.links(fps), _with_least(edges, "a", "b", 8)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_keys_of_all_tables_are_not_broadcast(spark):
    classes = spark.range(300).select(F.xxhash64("id").alias("f0"), F.col("id").alias("rep"))
    rows = classes.mapInPandas(lambda batches: (b[["rep"]].assign(key=b["rep"] % k) for b in batches for k in range(1, 90)), "key long, rep long")
    found = simhash._shared_keys(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {r.n for r in found.where("key = 88").collect()} >= {3} and found.where("low = high").isEmpty()
