"""Each operator against brute force on small tables with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docweir.llm import bpe, embedding_dedup, exact_dedup, hmm, language, line_dedup, packing, quality, simhash, token_codes, words
from docweir.llm.common import new_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
LANG_WORDS = {"en": "the house of and that thing running through water light", "de": "der haus und nicht schule zwischen wasser licht groß",
              "fr": "le maison et que être château eau lumière garçon"}


def corpus():
    """Texts in three languages with copies, near copies, nulls, empty and odd ones, a repeated row and a very long one."""
    r = random.Random(4)
    rows = []
    for i in range(120):
        lang = r.choice(list(LANG_WORDS))
        vocabulary = LANG_WORDS[lang].split()
        n = r.choice([1, 3, 40, 90])
        text = " ".join(r.choice(vocabulary) for _ in range(n))
        if i % 7 == 0:
            text = text.replace(" ", "\n", 2) + "\nShared LINE here\n  shared line here "
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    long = " ".join(r.choice(LANG_WORDS["en"].split()) for _ in range(30_000))
    rows += [(200, rows[2][1].replace(" ", "  \t"), "en", "s1", 1), (201, rows[2][1], None, None, None), (202, None, "en", "s0", 0), (203, "", None, "s1", 0),
             (204, " \n\t ", "de", "s2", 3), (205, long, "en", "s1", len(long)), (206, long + " end", "en", "s1", 1), (207, "1 2 3 !!", "fr", "s0", 8),
             (208, "日本 語 <|endoftext|> x", "en", "s0", 1), (None, "without an id", "en", "s0", 1), (None, None, None, None, None),
             rows[5], (209, " ".join(rows[2][1].split()[:-1]), "en", "s1", 1), (210, "A\u001cB C", None, "s0", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same with columns that the operators use names like, by case and by repetition."""
    from pyspark.sql import functions as F

    more = docs.select("*", F.lit(1).alias("TEXT"), F.lit(2).alias("component_id"), F.lit(3).alias("score"), F.lit(4).alias("_c0"), F.lit("x").alias("kept"))
    return more.toDF(*more.columns[:-1], "source")


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)


def byte_words(text):
    return (text or "").encode().lower().split()


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# -- exact dedup ------------------------------------------------------------------------------------------------------------------

def test_content_sort(docs, rows, none, clashing):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[SPACE.sub(" ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        seen = set()
        for i in ids:
            want.append((i, low, len(ids), i == low and i not in seen, hashlib.sha256(t.encode()).hexdigest()))
            seen.add(i)
    for splits in (1, 5, 17):
        assert ordered(exact_dedup.content_sort(docs, splits=splits)) == sorted(want, key=repr)
    assert ordered(exact_dedup.content_sort(clashing)) == sorted(want, key=repr)
    assert exact_dedup.content_sort(none).count() == 0


def test_content_sort_splits_one_group(spark):
    """A third of all rows are one text; its range is cut, and the pieces are joined again."""
    big = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same', concat('text ', id)) as text")
    out = exact_dedup.content_sort(big, splits=40)
    assert out.where("group_size = 1000 and keep_id = 0").count() == 1000 and out.where("kept").count() == 2001


# -- SimHash ----------------------------------------------------------------------------------------------------------------------

def plain_simhash(text, n):
    from xxhash import xxh64_intdigest

    w = byte_words(text)
    grams = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_groups(docs, rows, none, clashing):
    prints = [plain_simhash(t, 3) for _, t, *_ in rows]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    low = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        low[find(parent, k)].append(i)
    want = sorted(((i, f"{p:016x}", min((x for x in low[find(parent, k)] if x is not None), default=None)) for k, ((i, *_), p) in enumerate(zip(rows, prints))), key=repr)
    assert ordered(simhash.simhash_groups(docs, 3)) == want
    assert ordered(simhash.simhash_groups(clashing, 3)) == want
    assert simhash.simhash_groups(none).count() == 0


def jaccard_groups(rows, linked=lambda a, b: True):
    """Groups of rows whose texts' sets of five-word shingles have a similarity of 0.8 or more, of those pairs that may be linked."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (byte_words(t) for _, t, *_ in rows)]
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = sets[a] | sets[b]
            if (not both or len(sets[a] & sets[b]) >= 0.8 * len(both) - 1e-9) and linked(a, b):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return parent, sets


def kept_of(rows, parent):
    """Of each group, the row with the smallest id, then the smallest MD5."""
    low = {}
    for k, (i, t, *_) in enumerate(rows):
        own = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "")
        low[find(parent, k)] = min(low.get(find(parent, k), own), own, key=lambda x: x[:3])
    return sorted(((None if o[0] else o[1], o[3]) for o in low.values()), key=repr)


def test_keep_one(docs, rows, none, clashing):
    want = kept_of(rows, jaccard_groups(rows)[0])
    for table in (docs, clashing):
        kept = simhash.keep_one(table)
        assert kept.columns == table.columns
        got = kept.toDF(*(f"_{i}" for i in range(len(kept.columns)))).select("_0", "_1").collect()
        assert sorted(((r[0], r[1] or "") for r in got), key=repr) == want
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("flat, texts, task", [(simhash.FLAT, simhash.TEXTS, simhash.TASK), (2, 3, 40)])
def test_near_duplicates_are_compared_in_full(spark, monkeypatch, flat, texts, task):
    """Candidates as the sketches give them, all of them compared by their sets; whole, and with indexes, pieces and pairs of pieces."""
    for name, value in (("FLAT", flat), ("TEXTS", texts), ("TASK", task)):
        monkeypatch.setattr(simhash, name, value)
    r, rows = random.Random(12), []
    for base in range(30):
        vocabulary = [f"b{base}w{r.randrange(4000)}" for _ in range(r.choice([3, 60, 200, 400]))]
        rows.append((len(rows), " ".join(vocabulary)))
        for k in range(8):  # from almost equal to less than 0.8
            copy = vocabulary[:]
            for at in r.sample(range(len(copy)), min(len(copy), 1 + k * len(copy) // 150)):
                copy[at] = f"new{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(vocabulary).upper()))
    rows += [(2000, None), (2001, ""), (2002, " \n"), (None, rows[0][1]), (5, rows[5][1]), (3, "repeated id")]
    sketch = simhash.sketches([t for _, t in rows], 5, simhash.WORDS)
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    away = simhash._away(0.8, 64 * simhash.WORDS)
    apart = (bits[:, None] != bits).sum(2)
    lanes = np.min([(bits[:, None, lane] != bits[:, lane]).sum(2) for lane in simhash._lane_bits()], axis=0)
    near = list(range(len(rows)))
    for a, b in np.argwhere((lanes <= simhash.LANE_BUDGET) & (apart <= away)):
        x, y = find(near, a), find(near, b)
        near[max(x, y)] = min(x, y)
    parent, sets = jaccard_groups(rows, lambda a, b: apart[a, b] <= away and find(near, a) == find(near, b))
    every, found = 0, 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] != sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                every, found = every + 1, found + (find(parent, a) == find(parent, b))
    assert found >= 0.95 * every > 100
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted(((x.doc_id, x.text or "") for x in got.collect()), key=repr) == kept_of(rows, parent)


def test_fingerprint_is_the_first_word_of_a_sketch():
    texts = ["a b c d e f g h", None, "x", " ".join(f"w{i % 97}" for i in range(20_000))]
    assert (simhash.sketches(texts, 5, 4)[:, 0] == simhash.fingerprints(texts, 5)).all()
    assert [f"{x:016x}" for x in simhash.fingerprints(texts[:3], 5).tolist()] == [f"{plain_simhash(t, 5):016x}" for t in texts[:3]]


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_gray_index(budget):
    rng = np.random.default_rng(budget)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    x = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(5))])
    x = np.unique(np.concatenate([x, x[:50] ^ np.uint64(6), np.arange(40, dtype=np.uint64)]))
    index = simhash.GrayIndex(x)
    i, j = index.pairs(budget)
    got = {frozenset((int(index.sorted[a]), int(index.sorted[b]))) for a, b in zip(i, j)}
    want = {frozenset((int(a), int(b))) for k, a in enumerate(x) for b in x[:k] if (int(a) ^ int(b)).bit_count() <= budget}
    assert got == want and len(i) == len(got)


def test_common_block_values(spark, monkeypatch):
    """Fingerprints that share a block value are cut into pieces that still all meet."""
    monkeypatch.setattr(simhash, "TASK", 40)
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 9, 300))
    links = simhash.near_links(spark.createDataFrame([(int(v),) for v in x], "fp bigint"), 2).collect()
    root = simhash._roots(len(x), *(np.searchsorted(x, [r[k] for r in links]) for k in (0, 1)))
    pairs = [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 2]
    assert (root == simhash._roots(len(x), *(np.array(c) for c in zip(*pairs)))).all()


# -- tokens -----------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(words.tokenizer_path())


def library_ids(library, rows):
    return [library.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows]


def test_token_files(spark, docs, rows, none, clashing, library):
    for table in (docs, clashing):
        manifest = token_codes.write_token_files(table, new_path(spark, "t"), words.tokenizer_path(), end_id=0, file_tokens=5000)
        assert manifest.count() >= 4  # one a partition at least
        got = token_codes.read_token_files(manifest).orderBy("start").collect()
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple([*x, 0])) for (i, *_), x in zip(rows, library_ids(library, rows)))
        assert [r.doc_id for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i))
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.n_tokens
    empty = token_codes.write_token_files(none, new_path(spark, "t"), words.tokenizer_path())
    assert token_codes.read_token_files(empty).count() == 0


@pytest.mark.parametrize("n, top", [(0, 2), (1, 2), (512, 4), (1024, 5), (5000, 50_257), (4097, 2**32)])
def test_code_file(n, top):
    import io

    rng = np.random.default_rng(n)
    ids = (rng.integers(0, top, n) >> rng.integers(0, 12, n)).astype(np.uint32)
    f = token_codes.CodeFile(io.BytesIO(token_codes.write_codes(ids, [7, None], np.array([n // 2, n - n // 2]))))
    assert f.documents[0] == [7, None] and (f.tokens(0, n) == ids).all()
    for i in rng.integers(0, max(n, 1), 60) if n else []:
        assert f.token(int(i)) == ids[i]
        assert (f.tokens(int(i), min(n, int(i) + 70)) == ids[i : i + 70]).all()
    with pytest.raises(IndexError):
        f.token(n)


def test_bpe(docs, rows, none, clashing, library):
    want = sorted(((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
                   for (i, t, *_), x in zip(rows, library_ids(library, rows))), key=repr)
    assert ordered(bpe.bpe_round_trip(docs, words.tokenizer_path(), digests=True)) == want
    assert ordered(bpe.bpe_round_trip(clashing, words.tokenizer_path(), digests=True)) == want
    assert bpe.bpe_round_trip(none, words.tokenizer_path()).count() == 0
    plain = bpe.bpe_round_trip(docs.where("doc_id = 3"), words.tokenizer_path()).first()
    assert plain.decoded == rows[3][1] and plain.ids == library.encode(rows[3][1]).ids


def test_bpe_on_random_text(library):
    r = random.Random(2)
    alphabet = "abcdeehinorst THEéüß日本'.,!\n\t09  "
    cases = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)] + ["it's x'll", "a" * 3000, "\r\n \n"]
    _, own = bpe.own_encoder(words.tokenizer_path())
    for encoder in (own, words.library_encoder(words.tokenizer_path())):
        ids, n = encoder.encode(cases)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(c).ids for c in cases]


def test_bpe_of_long_words(library):
    """Exact merging of one unbroken run of a million letters, and of long runs of other kinds."""
    r = random.Random(3)
    b, _ = bpe.own_encoder(words.tokenizer_path())
    for text in ("".join(r.choice("abcdeehinorst") for _ in range(1_000_000)), "ab" * 100_000, "日" * 50_000, "".join(r.choice("ab") for _ in range(100_000))):
        assert b.encode_text(text) == library.encode(text, add_special_tokens=False).ids


def test_merging_takes_ranks_in_order():
    """Against the plain rule: the lowest rank of all pairs, the leftmost of equal ones, again and again."""
    b, _ = bpe.own_encoder(words.tokenizer_path())
    r = random.Random(9)
    for _ in range(400):
        word = "".join(r.choice("aeinorst th" if r.random() < 0.7 else "üé日x") for _ in range(r.randrange(40))).encode()
        ids = [b.byte_ids[x] for x in word]
        while len(ids) > 1:
            rank, i = min((b.merges.get(p, (1 << 30,))[0], i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == 1 << 30:
                break
            ids[i : i + 2] = [b.merges[ids[i], ids[i + 1]][1]]
        assert b.merge(word) == ids


def test_pairs_are_checked_right():
    b, _ = bpe.own_encoder(words.tokenizer_path())
    rng = np.random.default_rng(0)
    x, y = rng.choice(np.nonzero(b.whole)[0], (2, 4000))
    assert (b.compatible(x, y) == [b.merge(b.bytes[i] + b.bytes[j]) == [i, j] for i, j in zip(x, y)]).all()


def test_encoder_forgets(library):
    e = words.WordEncoder(lambda w: [library.encode(x).ids for x in w], lambda t: library.encode(t).ids, remembered=20)
    for k in range(6):
        texts = [f"w{k}a, w{i} again. the end" for i in range(10)]
        ids, n = e.encode(texts)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t).ids for t in texts]


def test_encoder_forgets_long_words(library):
    e = words.WordEncoder(lambda w: [library.encode(x).ids for x in w], lambda t: library.encode(t).ids, remembered=100)
    for k in range(8):
        texts = ["the end " + "xy" * 1500 + str(k), f"a {k}", "the " + "z" * 900]
        ids, n = e.encode(texts)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t).ids for t in texts]
        assert e.chars == sum(map(len, e.known)) < 12_000
    assert "the" in {k.strip() for k in e.known}


# -- packing ----------------------------------------------------------------------------------------------------------------------

def check_packed(got, rows, ids, limit):
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i in {i for i, *_ in rows}:
        found = sorted(zlib.crc32(np.array([*x, 2][a : a + n], "<u4").tobytes()) for (k, *_), x in zip(rows, ids) if k == i for a, n in cut(len(x) + 1, limit))
        assert sorted(r.ids_crc32 for r in by_doc[i]) == found
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


def cut(n, limit):
    first = n - (-(-n // limit) - 1) * limit
    return [(0, first), *((a, limit) for a in range(first, n, limit))]


@pytest.mark.parametrize("limit", [16, 1024])
def test_packing(docs, rows, none, clashing, library, limit):
    ids = library_ids(library, rows)
    for table in (docs, clashing):
        n = check_packed(packing.pack_documents(table, words.tokenizer_path(), limit).collect(), rows, ids, limit)
        assert n <= 1.15 * (sum(len(x) + 1 for x in ids) / limit) + 1
    assert packing.pack_documents(none, words.tokenizer_path()).count() == 0


@pytest.mark.parametrize("lengths", [[], [1024] * 5, [700] * 90 + [324] * 90, list(range(1, 1024)), [600] * 30 + [3] * 1000])
def test_plan_uses_the_histogram_up(lengths):
    h = np.bincount(lengths, minlength=1025) if lengths else np.zeros(1025, int)
    plan = packing.plan_sequences(h, 1024)
    used = Counter()
    for p, n in plan:
        assert sum(p) <= 1024 and n > 0
        for v in p:
            used[v] += n
    assert used == Counter(lengths)
    longer = sum(v > 512 for v in lengths)
    assert sum(n for _, n in plan) <= 1.05 * max(longer, sum(lengths) / 1024) + 1


@pytest.mark.parametrize("lengths", [range(20, 300), [300, 17], range(20, 900, 10), [5, 7, 700], [341], []])
def test_patterns_fill_sequences(lengths):
    lengths = np.array(lengths, int)
    patterns, times = packing.length_patterns(lengths, 1024)
    totals = (patterns * times).sum(1)
    assert len(set(totals.tolist())) <= 1 and (totals <= 1024).all() and (totals >= 1024 - packing.SLACK).all()
    assert set(patterns[patterns > 0].tolist()) <= set(lengths.tolist()) and (times[patterns > 0] > 0).all() and times.sum(1).max(initial=0) <= packing.PIECES


def test_short_documents_are_fitted_by_patterns():
    """Where no three pieces fill a sequence, repeated pieces do, and least squares uses most of the histogram."""
    h = np.bincount(np.random.default_rng(0).integers(20, 300, 20_000), minlength=1025)
    lengths = np.nonzero(h)[0]
    patterns, times = packing.length_patterns(lengths, 1024)
    x = packing.fit_repeats(h.astype(float), patterns, times)
    used = sum(np.bincount(patterns[:, c], x * times[:, c], len(h)) for c in range(3))
    assert (x >= 0).all() and abs(used - h)[1:].sum() < 0.05 * h.sum()
    assert sum(n for _, n in packing.plan_sequences(h, 1024)) <= 1.002 * (h * np.arange(1025)).sum() / 1024 + 1


def test_least_squares_against_a_plain_solver():
    """Repeat counts of a small problem against projected gradient steps on the dense matrix."""
    h = np.zeros(17)
    h[[2, 3, 4, 5, 7, 9, 12]] = [9, 4, 7, 5, 3, 2, 6]
    patterns, times = packing.length_patterns(np.nonzero(h)[0], 16)
    a = np.zeros((17, len(patterns)))
    for c in range(3):
        np.add.at(a, (patterns[:, c], np.arange(len(patterns))), times[:, c])
    a[0] = 0
    a *= np.sqrt(np.arange(17) / 16)[:, None]
    b, x = np.sqrt(np.arange(17) / 16) * h, np.zeros(len(patterns))
    for _ in range(20_000):
        x = np.maximum(0, x - a.T @ (a @ x - b) / np.linalg.norm(a, 2) ** 2)
    got = packing.fit_repeats(h, patterns, times, gain=1e-9)
    assert abs(np.linalg.norm(a @ got - b) - np.linalg.norm(a @ x - b)) < 1e-3 * np.linalg.norm(b)


# -- languages --------------------------------------------------------------------------------------------------------------------

def test_language(docs, rows, none, clashing):
    from pyspark.sql import functions as F

    out = language.mixture_language(docs, train=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = {r.doc_id: r for r in out.collect()}
    long = [(i, lang) for i, t, lang, *_ in rows if i is not None and i < 120 and len(t.split()) >= 40]
    assert sum(got[i].lang_pred == lang for i, lang in long) >= 0.98 * len(long)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (202, 203, 204, 207))
    assert out.count() == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert ordered(language.mixture_language(clashing)) == ordered(language.mixture_language(docs))
    kept = language.mixture_language(clashing, keep=True)
    assert kept.count() == len(rows) and kept.columns[: len(clashing.columns)] == [f"_c{i}" for i in range(len(clashing.columns))]
    assert language.mixture_language(none).count() == 0
    assert {r.lang_pred for r in language.mixture_language(docs, train=F.lit(False)).collect()} == {"und"}


def test_mixture_of_two(spark):
    en, fr = LANG_WORDS["en"], LANG_WORDS["fr"]
    table = spark.createDataFrame([(1, en * 5, "en"), (2, fr * 5, "fr"), (3, f"{en} {en} {fr}", None)], "doc_id bigint, text string, lang string")
    r = language.mixture_language(table).where("doc_id = 3").first()
    assert r.lang_pred == "en" and 0.5 < r.score < 0.8 and "fr:" in r.lang_mix


def test_mixture_of_four(spark):
    """Sets grow as long as the penalty lets them: four equal shares give all four."""
    r = random.Random(7)
    words_of = {k: [f"{k}{r.choice('aeiou')}{r.choice(k)}{r.choice('aeiou')}{k}" for _ in range(40)] for k in "bdgkmpz"}
    data = [(i, " ".join(r.choice(v) for _ in range(60)), k) for i, (k, v) in enumerate(words_of.items())]
    mixed = [(100 + n, " ".join(r.choice(words_of[k]) for _ in range(25) for k in list(words_of)[:n]), None) for n in range(1, 8)]
    table = spark.createDataFrame(data + mixed, "doc_id bigint, text string, lang string")
    for r in language.mixture_language(table).where("doc_id > 100").collect():
        n = r.doc_id - 100
        shares = dict((x.split(":")[0], float(x.split(":")[1])) for x in r.lang_mix.split(","))
        assert set(shares) == set(list(words_of)[:n]) and all(abs(x - 1 / n) < 0.05 for x in shares.values()), (n, shares)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    table = spark.createDataFrame([(i, "a text", f"l{i}") for i in range(4)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.mixture_language(table)


def plain_language(learn, texts):
    """Counts, likelihoods, growth of sets and EM restated with dictionaries and loops: (language, share, sense) of each text."""
    def buckets(word):
        b = b" " + word.encode() + b" "
        return [((x << 16 | y << 8 | z) * 2_654_435_761 >> 13) % language.BUCKETS for x, y, z in zip(b, b[1:], b[2:])]

    lettered = lambda t: [w for w in (t or "").lower().split() if any(c.isalpha() for c in w)]
    counts = {}
    for lang, t in learn:
        for w in lettered(t):
            counts.setdefault(lang, Counter()).update(buckets(w))
    langs, half = sorted(counts), language.BUCKETS / 2
    total = {k: sum(c.values()) + half for k, c in counts.items()}
    out = []
    for t in texts:
        logs = [[sum(math.log((counts[k][b] + 0.5) / total[k]) for b in buckets(w)) for k in langs] for w in lettered(t)]
        if not logs or not langs:
            out.append(("und", 0.0, None))
            continue
        like = [[math.exp(x - max(row)) for x in row] for row in logs]
        mix = lambda share: [max(1e-30, sum(x * s for x, s in zip(row, share))) for row in like]
        total_log = lambda share: sum(map(math.log, mix(share)))
        alone = lambda k: [float(i == k) for i in range(len(langs))]
        share = alone(max(range(len(langs)), key=lambda k: total_log(alone(k))))
        best = total_log(share)
        while min(share) == 0:
            def entered(k):
                return [0.9 * s + 0.1 * (i == k) for i, s in enumerate(share)]
            new = entered(max((k for k in range(len(langs)) if not share[k]), key=lambda k: total_log(entered(k))))
            for _ in range(language.STEPS):
                m = mix(new)
                new = [sum(row[k] * new[k] / x for row, x in zip(like, m)) / len(like) for k in range(len(langs))]
            value = total_log(new) - 2 * math.log(len(like) + 1)
            if value <= best:
                break
            best, share = value, new
        m = mix(share)
        sense = sum(max(row) + math.log(x) > len(buckets(w)) * -math.log(language.BUCKETS) for row, x, w in zip(logs, m, lettered(t))) / len(like)
        out.append((langs[share.index(max(share))], max(share), sense))
    return out


def test_language_query_against_plain_em(spark, rows, docs, tmp_path):
    from docweir.llm.queries import queries

    r = random.Random(2)
    mixed = [(300 + i, " ".join(r.choice(LANG_WORDS[k].split()) for k in ks for _ in range(20)), None, None, 0) for i, ks in enumerate((["en", "de"], ["en", "de", "fr"], ["fr", "en"]))]
    table = [x for x in rows + mixed if len(x[1] or "") < 10_000] + [(400, "xq9$jj zzkq%w 7vvqx ~~", None, None, 0)]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    want = plain_language([(lang, t) for i, t, lang, *_ in table if lang and t and not held(i)], [t for _, t, *_ in table])
    out = queries()["op3_language_id"](spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = sorted(((x.doc_id, x.held_out, x.lang_pred, round(x.score, 2)) for x in out.collect()), key=repr)
    exact = sorted(((i, held(i), k, p) for (i, *_), (k, p, _) in zip(table, want)), key=repr)
    assert [x[:3] for x in got] == [x[:3] for x in exact]
    assert all(abs(a[3] - b[3]) < 0.02 for a, b in zip(got, exact))
    sense = {x.doc_id: x.sense for x in language.mixture_language(spark.createDataFrame(table, SCHEMA)).where("doc_id >= 300").collect()}
    assert sense[400] == 0 and all(sense[i] == 1 for i in (300, 301, 302))


# -- language model ---------------------------------------------------------------------------------------------------------------

def test_hmm_base_counts(docs, rows, none, clashing):
    from pyspark.sql import functions as F

    train = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))
    trained = [i is None or zlib.crc32(str(i).encode()) % 10 != 0 for i, *_ in rows]
    counts = Counter()
    for (_, t, *_), x in zip(rows, trained):
        if x:
            counts.update([*byte_words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = defaultdict(list)
    for (i, t, *_), x in zip(rows, trained):
        tokens = [*byte_words(t), None]
        want[i].append((x, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), 6)))
    for table in (docs, clashing):
        got = defaultdict(list)
        for r in hmm.hmm_scores(table, train).collect():
            got[r.doc_id].append((r.trained, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)))
            assert r.score < 0
        assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert hmm.hmm_scores(none).count() == 0
    untrained = hmm.hmm_scores(docs, F.lit(False)).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_hmm_with_rare_words(docs, monkeypatch):
    """Words beyond the broadcast ones are counted and scored by the join, to the same sums."""
    full = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in hmm.hmm_scores(docs).collect()}
    monkeypatch.setattr(hmm, "COUNTED", 10)
    monkeypatch.setattr(hmm, "SYMBOLS", 5)
    few = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 6)) for r in hmm.hmm_scores(docs).collect()}
    assert few == full


def test_hmm_learns(spark):
    """Two kinds of documents with words of their own: states that stay make them likelier than word counts do."""
    r = random.Random(1)
    kinds = [[f"{a}{i}" for i in range(40)] for a in "xy"]
    table = spark.createDataFrame([(i, " ".join(r.choice(kinds[i % 2]) for _ in range(60))) for i in range(200)], "doc_id bigint, text string")
    from pyspark.sql import functions as F

    out = hmm.hmm_scores(table, F.col("doc_id") < 150).where("not trained").groupBy().sum("base_score", "score").first()
    assert out["sum(score)"] > out["sum(base_score)"] + 50 * 60 * 0.2


def test_forward_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    m = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(4), 3).T)
    sequences = [rng.integers(0, 4, n) for n in (1, 4, 6, 2)]
    want = []
    for s in sequences:
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= m.move[a, b] * m.emit[x, b]
            total += p
        want.append(math.log10(total))
    for window in (1, 3, 512):
        assert np.allclose(m.log10(np.concatenate(sequences), np.array([len(s) for s in sequences]), window), want, atol=1e-5)


@pytest.mark.parametrize("window", [1, 2, 3, 512])
def test_expected_counts_against_enumeration(window):
    """Counts over all hidden paths of whole sequences, whatever the windows they are worked on in."""
    import itertools

    rng = np.random.default_rng(5)
    m = hmm.Hmm(rng.dirichlet(np.ones(2)), rng.dirichlet(np.ones(2), 2), rng.dirichlet(np.ones(4), 2).T)
    sequences = [rng.integers(0, 4, n) for n in (1, 4, 9, 2, 3, 6)]
    start, move, emit, likelihood = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for s in sequences:
        paths = {}
        for path in itertools.product(range(2), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                p *= m.move[a, b] * m.emit[x, b]
            paths[path] = float(p)
        total = sum(paths.values())
        likelihood += math.log(total)
        for path, p in paths.items():
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for a, x in zip(path, s):
                emit[x, a] += p / total
    got = m.expected(np.concatenate(sequences), np.array([len(s) for s in sequences]), window)
    assert np.allclose(got, np.concatenate([start, move.ravel(), emit.ravel(), [likelihood]]), atol=1e-4)


def test_one_document_counts_one_start():
    rng = np.random.default_rng(0)
    m = hmm.Hmm(np.full(3, 1 / 3), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(50), 3).T)
    got = m.expected(rng.integers(0, 50, 2000), np.array([2000]))
    assert math.isclose(got[:3].sum(), 1, rel_tol=1e-4) and math.isclose(got[3:12].sum(), 1999, rel_tol=1e-4) and math.isclose(got[12:-1].sum(), 2000, rel_tol=1e-4)


def test_likelihood_rises_with_each_pass(spark):
    r = random.Random(3)
    texts = []
    for _ in range(300):
        state, out = r.randrange(3), []
        for _ in range(r.randrange(5, 900)):
            state = state if r.random() < 0.9 else r.randrange(3)
            out.append(10 * state + min(9, int(r.expovariate(0.4))))
        texts.append((np.array(out, np.uint16).tobytes(),))
    table = spark.createDataFrame(texts, "symbols binary").repartition(3)
    model, trace = hmm.baum_welch(table, 30, states=3, passes=12, gain=1e-4)
    assert len(trace) > 2 and all(b > a - 1e-6 for a, b in zip(trace, trace[1:]))
    assert len(trace) < 12 and trace[-1] - trace[-2] < 1e-4  # it stops when the likelihood settles
    assert np.all(np.diag(model.move) > 0.8)


def test_hmm_query_against_plain_scoring(spark, docs, rows, tmp_path, monkeypatch):
    """Scores of the query from a restated forward recursion, word by word, under the model that training gives; with frequent, classed and joined words."""
    from docweir.llm.queries import queries

    monkeypatch.setattr(hmm, "COUNTED", 20)
    monkeypatch.setattr(hmm, "SYMBOLS", 8)
    table = [x for x in rows if len(x[1] or "") < 10_000]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found, plain = [], hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *a, **k: found.append(plain(*a, **k)) or found[-1])
    out = queries()["op7_hmm_scoring"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, *_ in table if not held(i) for w in byte_words(t))
    by_count = sorted(counts, key=lambda w: (-counts[w], w))
    bins = Counter(math.floor(math.log2(c) * 64) for c in counts.values())
    room, least = 20, None
    for b in sorted(bins, reverse=True):
        room -= bins[b]
        if room < 0:
            break
        least = b
    own = [w for w in by_count if math.floor(math.log2(counts[w]) * 64) >= least][:8]
    classes = defaultdict(list)
    for w in counts:
        if w not in own:
            classes[hmm.word_class(w)].append(counts[w])
    (model, _), = found

    def score(t):
        alpha, total = None, 0.0
        for w in [*byte_words(t), None]:
            symbol = len(own) if w is None else own.index(w) if w in own else len(own) + 1 + hmm.word_class(w)
            alpha = (model.start if alpha is None else alpha @ model.move) * model.emit[symbol].astype(float)
            total += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
            if w is not None and w not in own:
                mates = classes[hmm.word_class(w)]
                total += math.log10((counts.get(w, 0) + 0.1) / (sum(mates) + 0.1 * (len(mates) + 1)))
        return total

    want = sorted(((i, held(i), round(score(t), 2)) for i, t, *_ in table), key=repr)
    got = sorted(((r.doc_id, r.held_out, round(r.score, 2)) for r in out.collect()), key=repr)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a[2] - b[2]) <= 0.02 for a, b in zip(got, want))


# -- lines ------------------------------------------------------------------------------------------------------------------------

def plain_lines(rows, least, first):
    keys = [[line_dedup.line_key(x) for x in (t or "").split("\n")] for _, t, *_ in rows]
    n, low = Counter(), {}
    for (i, *_), ks in zip(rows, keys):
        for k in set(ks):
            if k:
                n[k] += 1
                if i is not None:
                    low[k] = min(low.get(k, i), i)
    out = []
    for (i, t, *_), ks in zip(rows, keys):
        lines, kept, taken = (t or "").split("\n"), [], set()
        for line, k in zip(lines, ks):
            if n[k] >= least:
                if not first or low.get(k) != i or k in taken:
                    continue
                taken.add(k)
            kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sent", [line_dedup.SENT, 0])
@pytest.mark.parametrize("least, first", [(10, False), (2, True)])
def test_lines(docs, rows, none, clashing, least, first, sent):
    for table in (docs, clashing):
        assert ordered(line_dedup.repeated_lines(table, least, keep_first=first, sent=sent)) == plain_lines(rows, least, first)
    assert line_dedup.repeated_lines(none, sent=sent).count() == 0
    kept = line_dedup.repeated_lines(clashing, least, keep_first=first, keep=True, sent=sent)
    assert kept.count() == len(rows) and kept.columns[-3:] == ["n_lines", "n_dropped", "text"]


def test_full_filters_miss_nothing(docs, rows):
    """Filters far too small make more keys suspects; the result stays exact."""
    assert ordered(line_dedup.repeated_lines(docs, 2, keep_first=False, filter_bits=1 << 12)) == plain_lines(rows, 2, False)


def test_filters_grow_with_the_lines(spark):
    few = spark.createDataFrame([("a\nb",), (None,), ("",)], "text string")
    assert line_dedup.filter_bits_for(few) == line_dedup.LEAST_BITS and line_dedup.filter_bits_for(few.where("false")) == line_dedup.LEAST_BITS
    many = spark.range(1).selectExpr("repeat('x\n', 3000000) as text")
    assert line_dedup.filter_bits_for(many) == 1 << 25


def test_twice_seen_filter(spark):
    """Whatever two rows have is suspected; of what only one has, nearly nothing."""
    table = spark.range(200).selectExpr("concat_ws('\n', transform(sequence(0, 99), k -> concat('own ', id, ' ', k)), concat('pair ', id % 100)) as text").repartition(5)
    filters = line_dedup.suspected_repeats(table, 1, line_dedup.filter_bits_for(table))
    pairs = line_dedup._hashes([f"pair {i}" for i in range(100)])
    own = line_dedup._hashes([f"own {i} {k}" for i in range(200) for k in range(100)])
    assert line_dedup.suspicious(filters, pairs).all() and line_dedup.suspicious(filters, own).mean() < 0.01


# -- quality ----------------------------------------------------------------------------------------------------------------------

def test_quality(spark):
    r = random.Random(5)
    data, labels = [], []
    for i in range(600):
        bad = r.random() < 0.25
        text = " ".join(r.choice(LANG_WORDS["en"].split()) + (r.choice(["%%%", "$$$"]) if bad else "") for _ in range(r.randrange(20, 60)))
        data.append((i, text, "en", f"s{r.randrange(4)}", len(text)))
        if i % 2:
            labels.append((i, int(not bad), None))
    labels += [(1, None, 0), (99_999, 1, 0), (None, 1, 1)]
    data += [(1000, None, None, None, None), (None, "", None, None, None), data[0]]
    docs, known = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = quality.co_trained_quality(docs, known)
    got = {x.doc_id: x for x in out.collect()}
    assert out.count() == len(data)
    assert sum(got[i].kept == ("%%%" not in t and "$$$" not in t) for i, t, *_ in data[:600]) >= 590
    assert all(0 <= x.score <= 1 and x.kept == (x.score >= 0.5) for x in got.values())
    kept = quality.co_trained_quality(docs, known, keep=True)
    assert kept.columns[:5] == [f"_c{i}" for i in range(5)] and kept.count() == len(data)
    nothing = known.where("false")
    assert {(x.score, x.kept) for x in quality.co_trained_quality(docs, nothing).collect()} == {(0.5, True)}
    assert {x.kept for x in quality.co_trained_quality(docs, known.where("quality = 1")).collect()} == {True}
    assert quality.co_trained_quality(docs.where("false"), known).count() == 0


def plain_views(text, source, lang, chars):
    """Features of one row, restated character by character."""
    raw = (text or "").encode()
    grams = [0.0] * quality.GRAMS
    for a, b, c in zip(raw, raw[1:] + b" ", raw[2:] + b"  "):
        grams[((a << 16 | b << 8 | c) * 2_654_435_761 >> 12) % quality.GRAMS] += 1
    size = max(1, len(raw))
    upper, digit, space = (sum(chr(x) in kind for x in raw) for kind in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \n"))
    other = sum(x < 128 and not chr(x).isalnum() and chr(x) not in " \n" for x in raw)
    lines = raw.count(b"\n") + 1
    layout = [math.log1p(len(raw)) / 10, math.log1p(lines) / 5, math.log1p(len(raw) / lines) / 10, *(4 * x / size for x in (upper, digit, space, other))]
    meta = [0.0] * (quality.SOURCES + quality.LANGS) + [math.log1p(max(0, chars or 0)) / 10]
    meta[zlib.crc32((source or "").encode()) % quality.SOURCES] = 1
    meta[quality.SOURCES + zlib.crc32((lang or "").encode()) % quality.LANGS] = 1
    return np.array([math.sqrt(g / size) for g in grams] + layout, np.float32), np.array(meta, np.float32)


def quality_corpus(n, labelled):
    """Bad documents come from bad sources. Half of the bad ones speak with words that no labelled document has."""
    r = random.Random(31)
    data, labels = [], []
    for i in range(n):
        bad, strange = r.random() < 0.3, r.random() < 0.5
        vocabulary = ["@@", "##"] if bad and not (strange and i >= labelled) else ["zxq", "qxz"] if bad else ["and", "so"]
        text = " ".join(r.choice([*LANG_WORDS["en"].split(), *vocabulary * 6]) for _ in range(r.randrange(10, 30)))
        data.append((i, text, "en", f"bad{r.randrange(3)}" if bad else f"good{r.randrange(3)}", len(text)))
        if i < labelled:
            labels.append((i, int(not bad), None))
    return data, labels


def test_quality_learns_from_all_unlabelled_rows(spark):
    """Words that only unlabelled rows have, most of them after the first 3,000, are learned from the other view's labels."""
    data, labels = quality_corpus(5000, 400)
    plain = [i for i, t, *_ in data if i >= 400 and "zxq" in t]
    data = [x for x in data if x[0] < 400 or x[0] not in set(plain) or x[0] > 3500]
    docs, known = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    strange = [i for i, t, *_ in data if "zxq" in t]
    assert len(strange) > 100
    alone = {r.doc_id: r.text_score for r in quality.co_trained_quality(docs, known, rounds=0).collect()}
    taught = {r.doc_id: r.text_score for r in quality.co_trained_quality(docs, known).collect()}
    assert sum(alone[i] < 0.5 for i in strange) < 0.1 * len(strange) and sum(taught[i] < 0.5 for i in strange) > 0.9 * len(strange)


def test_quality_query_against_plain_co_training(spark, tmp_path):
    """The query against the same model fitted in one process on features restated plainly; the unlabelled rows are summed in another order."""
    from docweir.llm.queries import queries

    data, labels = quality_corpus(600, 300)
    data += [(900, None, None, None, None), (901, "", "en", "good1", 0)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    x = [plain_views(t, source, lang, chars) for _, t, lang, source, chars in data]
    y = np.array([q for _, q, _ in labels])
    trainer = quality.Trainer(tuple(np.stack([f[v] for f in x[: len(y)]]) for v in (0, 1)), y)
    models = [trainer.fit()]
    for _ in range(3):
        model, handed = models[-1], ({}, {})
        for f in x[len(y) :]:
            odds = [a * float(f[v] @ w[:-1] + w[-1]) + b for v, (w, (a, b)) in enumerate(zip(model.weights, model.scales))]
            for v in (0, 1):
                if abs(odds[v]) >= math.log(9):
                    direction, middle = model.planes[1 - v]
                    group = sum(1 << k for k in range(quality.PLANES) if f[1 - v] @ direction[:, k] > middle[k])
                    handed[1 - v].setdefault(group + (1 << quality.PLANES) * (odds[v] > 0), []).append(f[1 - v])
        models.append(trainer.fit(tuple({b: (len(m), np.mean(m, axis=0, dtype=float)) for b, m in h.items()} for h in handed)))

    def off(got, model):
        out = []
        for (i, *_), f in zip(data, x):
            odds = [a * float(f[v] @ w[:-1] + w[-1]) + b for v, (w, (a, b)) in enumerate(zip(model.weights, model.scales))]
            out.append(abs(got[i].score - 1 / (1 + math.exp(-np.clip(sum(odds) - model.prior, -500, 500)))))
        return sorted(out)

    docs, known = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    for rounds in (0, 1):
        assert off({r.doc_id: r for r in quality.co_trained_quality(docs, known, rounds=rounds).collect()}, models[rounds])[-1] < 1e-3
    # Later rounds start from rows at the edge of being sure, which a last bit of a sum moves.
    out = queries()["op9_quality"](spark, str(tmp_path))
    assert out.columns[:2] == ["doc_id", "score"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(data) == out.count() and all(r.kept == (r.score >= 0.5) for r in got.values())
    assert off(got, models[3])[int(0.95 * len(data))] < 0.02


def test_logistic_fit_against_newton():
    rng = np.random.default_rng(2)
    x, n = rng.standard_normal((300, 4)).astype(np.float32), rng.integers(1, 5, 300)
    y = (x @ [1, -2, 0.5, 0] + rng.standard_normal(300) > 0.3).astype(np.float32)
    weight, w, z = 0.5 * n / np.where(y > 0, n[y > 0].sum(), n[y <= 0].sum()), np.zeros(5), np.c_[x, np.ones(300)]
    keep = np.diag([1e-3] * 4 + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T * (weight * p * (1 - p)) @ z + keep, z.T @ (weight * (p - y)) + keep @ w)
    assert np.allclose(quality.fit_logistic(x, y, n.astype(float), steps=3000, ridge=1e-3), w, atol=1e-2)


def test_quality_of_repeated_ids_is_reproducible(spark):
    """Rows of one labelled id with different texts, in any order, give one model."""
    data, labels = quality_corpus(300, 100)
    data += [(i, f"another text of {i} " * 3, "de", "good0", 5) for i in range(0, 100, 3)]
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    one, two = (ordered(quality.co_trained_quality(spark.createDataFrame(x, SCHEMA).repartition(n), known).selectExpr("doc_id", "round(score, 3)"))
                for x, n in ((data, 2), (data[::-1], 5)))
    assert one == two


def test_views_do_not_depend_on_neighbours(monkeypatch):
    texts = ["a line\nof 12 WORDS!", None, "é" * 50, "x" * 4000, "", "the end"]
    rest = lambda n: (["s"] * n, [None] * n, [3] * n)
    text, meta = quality.views(texts, *rest(6))
    alone = [quality.views([t], *rest(1)) for t in texts]
    assert (text == np.concatenate([a for a, _ in alone])).all() and (meta == np.concatenate([b for _, b in alone])).all()
    monkeypatch.setattr(quality, "PIECE", 7)
    cut, same = quality.views(texts, *rest(6))
    assert (cut == text).all() and (same == meta).all()


def test_quality_with_clashing_names(clashing, spark):
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id bigint, quality int, toxic int")
    assert quality.co_trained_quality(clashing, known).count() == clashing.count()


# -- embeddings -------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("number", ["float", "double"])
@pytest.mark.parametrize("cell", [embedding_dedup.CELL, 30, 8])
def test_embeddings(spark, monkeypatch, cell, number):
    monkeypatch.setattr(embedding_dedup, "TILE", (16, 40))
    monkeypatch.setattr(embedding_dedup, "PAIRS", 50)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 16))
    x = [*base, *(base[:30] + 0.05 * rng.standard_normal((30, 16))), *(base[0] + 0.1 * rng.standard_normal((40, 16))), base[3], base[3], 2 * base[3]]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, [float("inf")] + [1.0] * 15), (505, []), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id bigint, embedding array<{number}>, label int, N_LINKS string")
    good = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    parent, n = list(range(len(rows))), Counter()
    for a in good:
        for b in good:
            if b < a and len(rows[a][1]) == len(rows[b][1]) and cos(rows[a][1], rows[b][1]) >= 0.9:
                n[a] += 1
                n[b] += 1
                p, q = find(parent, a), find(parent, b)
                parent[max(p, q)] = min(p, q)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[find(parent, k)].append(i)
    top = lambda k: min((i for i in low[find(parent, k)] if i is not None), default=None)
    want = sorted(((i, n[k], top(k), i == top(k)) for k, (i, _) in enumerate(rows)), key=repr)
    assert ordered(embedding_dedup.subspace_join(table, cell=cell)) == want
    assert embedding_dedup.subspace_join(table.where("false")).count() == 0


def test_cells_meet_whatever_is_near():
    """Of any two vectors within the budget of a block, both are in one cell or exactly one visits the other's."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    x = np.concatenate([x, x[:200] + 0.2 * rng.standard_normal((200, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    space = embedding_dedup.Space(8, 2, 0.2, x.mean(0), 4)
    r = embedding_dedup._rotated(x, space.turn)
    for block in (0, 1):
        own, (row, other) = space.cells(r, block), space.visits(r, block)
        assert (own[row] != other).all() and len(set(zip(row.tolist(), other.tolist()))) == len(row)
        seen = set(zip(row.tolist(), other.tolist()))
        for i in range(len(x)):
            for j in range(i):
                if ((r[i, space.spans[block]] - r[j, space.spans[block]]) ** 2).sum() <= space.budgets[block]:
                    assert own[i] == own[j] or ((i, own[j]) in seen) + ((j, own[i]) in seen) == 1


# -- pipeline ---------------------------------------------------------------------------------------------------------------------

def test_pipeline(spark, docs, rows, clashing, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(100)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, none):
        table.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        now = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.schema.names == now.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in now.schema]
            out.write.parquet(f"{tmp_path}/{table.count()}-{k}")
            now = spark.read.parquet(f"{tmp_path}/{table.count()}-{k}")
        assert (now.count() > 50) == (table.count() > 0)
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, clashing, str(tmp_path)).count() > 0


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Ids and texts after each stage against a plain version of it, over copies, near copies, passages that many documents share, noise and bad documents."""
    import corpus_pipeline

    r = random.Random(77)
    vocabulary = {k: [f"{k}{r.choice('aeiou')}{r.choice('lnrst')}{r.choice('aeiou')}{x}" for x in "abcdefghijklmnop" for _ in range(12)] for k in ("b", "g")}
    line = lambda k, n=14: " ".join(r.choice(vocabulary[k]) for _ in range(n))
    rows = []
    for _ in range(150):
        k = r.choice("bg")
        rows.append((len(rows), "\n".join(line(k) for _ in range(r.randrange(2, 9))), k, f"s{r.randrange(3)}"))
    copied, shared = line("b", 60) + "\n" + line("b"), line("g")
    rows += [(len(rows) + i, copied, "b", "s0") for i in range(14)]
    rows += [(300 + i, line("g") + "\n" + shared + "\n" + line("g"), "g", "s1") for i in range(12)]
    for i in range(10):  # near copies of 0.8 and more, and of less
        base = line("g", 120).split()
        rows.append((400 + 10 * i, " ".join(base), "g", "s2"))
        for j in range(1, 5):
            copy = base[:]
            copy[10 * j : 10 * j + (1, 2, 30, 1)[j - 1]] = ["bxeny"] * (1, 2, 30, 1)[j - 1]
            rows.append((400 + 10 * i + j, " ".join(copy), "g", "s2"))
    rows += [(600 + i, " ".join(f"%{r.randrange(10**9)}$!x~{r.randrange(10**9)}" for _ in range(12)), None, "s0") for i in range(6)]
    rows += [(700 + i, " ".join(r.choice(["###", "$$$", *vocabulary["b"][:20]]) for _ in range(40)), "b", "s0") for i in range(60)]
    rows += [(800, None, "b", "s0"), (801, "", "b", "s0"), (802, "12 34", "b", "s0"), (None, line("b", 30), "b", "s0")]
    labels = [(i, 0 if 700 <= i < 760 else 1, 0) for i, *_ in rows if i is not None and i % 2 == 0]
    docs = spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows], SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, stages = docs, dict(corpus_pipeline.STAGES)
    of = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=repr)

    # Language: documents without a letter or without sense go.
    sense = [s for *_, s in plain_language([(k, t) for _, t, k, _ in rows if t and k], [t for _, t, *_ in rows])]
    want = [(i, t) for (i, t, *_), s in zip(rows, sense) if s is not None and s >= 0.5]
    now = stages["language_id"](spark, now, str(tmp_path))
    assert of(now) == sorted(want, key=repr) and {i for i, _ in want} == {i for i, *_ in rows} - {800, 801, 802, *range(600, 606)}

    # Quality: what the classifier rejects, which the bad ones are and good ones are not.
    scores = {x.doc_id: x.kept for x in quality.co_trained_quality(now, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    want = [(i, t) for i, t in want if scores[i]]
    now = stages["quality"](spark, now, str(tmp_path))
    assert of(now) == sorted(want, key=repr) and {i for i, _ in want} == {i for i, *_ in rows} - {800, 801, 802, *range(600, 606), *range(700, 760)}

    # Lines of 10 documents or more stay in the first of them.
    want = [(i, t) for i, _, _, t in plain_lines(want, 10, True)]
    now = stages["line_dedup"](spark, now, str(tmp_path))
    assert of(now) == sorted(want, key=repr)
    assert sum(shared in t for _, t in want) == 1 and sum(t == copied for _, t in want) == 1

    # One of each group of near-duplicates stays.
    want = kept_of(want, jaccard_groups(want)[0])
    now = stages["simhash_near_dedup"](spark, now, str(tmp_path))
    assert of(now) == want and {i for i, _ in want if i is not None and 400 <= i < 500} == {400 + 10 * i + j for i in range(10) for j in (0, 3)}

    # Packing keeps every token.
    library = Tokenizer.from_file(words.tokenizer_path())
    ids = library_ids(library, want)
    got = stages["packing"](spark, now, str(tmp_path)).collect()
    assert check_packed(got, want, ids, 1024) <= 1.1 * sum(len(x) + 1 for x in ids) / 1024 + 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(((x.doc_id, x.piece, x.ids_crc32) for x in whole.collect()), key=repr) == sorted(((x.doc_id, x.piece, x.ids_crc32) for x in got), key=repr)


def test_pipeline_without_known_languages_keeps_documents(spark):
    import corpus_pipeline

    table = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "12", None, "s", 1), (3, None, None, "s", 0)], SCHEMA)
    assert [x.doc_id for x in corpus_pipeline.language_id(spark, table, "").collect()] == [1]


def test_pipeline_keeps_one_of_many_copies(spark):
    import corpus_pipeline

    text = "\n".join(" ".join(f"w{line}x{k}" for k in range(12)) for line in range(5))
    rows = [(100 + i, text, "en", "s0", len(text)) for i in range(12)] + [(1, "some other words\n" + text.split("\n")[0], "en", "s0", 1), (2, "apart", "en", "s0", 5)]
    lines = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    rest = "\n".join(text.split("\n")[1:])  # document 1 is the first one with the first line
    assert got == {1: (rows[12][1], len(rows[12][1])), 2: ("apart", 5), 100: (rest, len(rest))} | {i: ("", 0) for i in range(101, 112)}
    kept = [r.text for r in corpus_pipeline.near_dedup(spark, lines, "").collect()]
    assert sorted(kept) == sorted([rows[12][1], "apart", rest, ""])


# -- registered queries -----------------------------------------------------------------------------------------------------------

def test_queries_of_whole_tables(spark, rows, library, tmp_path):
    """Each registered query with its own parameters over a folder of tables, its columns, types and rows, against plain versions."""
    from docweir.llm.queries import queries

    r = random.Random(8)
    run_on = "".join(r.choice("abcdeehinorst") for _ in range(50_000))  # one very long word
    table = [x for x in rows if len(x[1] or "") < 10_000] + [(500, run_on, "en", "s", 1), (501, "before " + run_on + " after", "en", "s", 1)]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = np.random.default_rng(1).standard_normal((40, 16)).astype(np.float32)
    vectors[20:30] = vectors[:10] * 3
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = {n: queries()[n](spark, str(tmp_path)) for n in queries() if n[:3] not in ("op3", "op7", "op9")}
    got = {n: sorted(map(tuple, df.collect()), key=repr) for n, df in out.items()}
    kinds = {n: dict(df.dtypes) for n, df in out.items()}

    texts = [(i, t or "") for i, t, *_ in table]
    prints = [plain_simhash(t, 3) for _, t in texts]
    assert list(kinds["op1_simhash_near_dedup"])[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted(x[:2] for x in got["op1_simhash_near_dedup"] if x[0] is not None) == sorted((i, f"{p:016x}") for (i, _), p in zip(texts, prints) if i is not None)

    ids = [library.encode(t, add_special_tokens=False).ids for _, t in texts]
    raw = lambda x: np.array(x, "<u4").tobytes()
    assert list(kinds["op2_token_codes"].items())[:4] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted((x[0], x[2], x[3]) for x in got["op2_token_codes"] if x[0] is not None) == sorted((i, len(x) + 1, zlib.crc32(raw([*x, 0]))) for (i, _), x in zip(texts, ids) if i is not None)
    by_start = sorted(got["op2_token_codes"], key=lambda x: x[1])
    assert [x[1] for x in by_start] == np.cumsum([0, *(x[2] for x in by_start)])[:-1].tolist() and [x[0] for x in by_start if x[0] is not None] == sorted(i for i, _ in texts if i is not None)

    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert list(kinds["op4_bpe"].items())[:4] == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert got["op4_bpe"] == sorted(((i, len(x), sha(raw(x)), sha(t.encode())) for (i, t), x in zip(texts, ids)), key=repr)

    folded = [SPACE.sub(" ", t) for _, t in texts]
    sizes = Counter(folded)
    assert list(kinds["op5_exact_dedup"])[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(x[2::2] for x in got["op5_exact_dedup"]) == sorted((sizes[t], sha(t.encode())) for t in folded)

    assert list(kinds["op6_embedding_near_dedup"].items())[:4] == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert got["op6_embedding_near_dedup"] == sorted(((i, int(i < 10 or 20 <= i < 30), i - 20 if 20 <= i < 30 else i, not 20 <= i < 30) for i in range(40)), key=repr)

    assert list(kinds["op8_line_dedup"].items())[:4] == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")]
    assert got["op8_line_dedup"] == sorted(((i, n, k, sha(t.encode())) for i, n, k, t in plain_lines(table, 10, False)), key=repr)

    assert list(kinds["op10_packing"])[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packed(out["op10_packing"].collect(), table, ids, 1024)


# -- shared parts -----------------------------------------------------------------------------------------------------------------

def test_connected_components(spark):
    from docweir.llm.common import connected_components

    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(2000 + r.randrange(80), 2000 + r.randrange(80)) for _ in range(60)] + [(7, 7), (3, 2)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {(c.id, c.component) for c in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(x, find(parent, x)) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_common_fingerprints_are_joined_apart(docs, monkeypatch):
    want = ordered(simhash.simhash_groups(docs, 3))
    monkeypatch.setattr(simhash, "HOT", 2)
    assert ordered(simhash.simhash_groups(docs, 3)) == want


def test_scratch_tables_go(spark):
    from docweir.llm import common

    before = common.stored(spark.range(2), "before")
    with common.Scratch() as scratch:
        inner = common.stored(spark.range(3), "inner")
        out = scratch.finish(inner.selectExpr("id + 1 as id"), "out")
    assert before.count() == 2 and out.count() == 3
    with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.schema("id bigint").parquet(inner.inputFiles()[0] if inner.inputFiles() else f"{common.shared_dir(spark)}/gone").count()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from docweir.llm import common

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(applicationId="other", master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(cluster)


def test_shared_folder_is_the_sessions(spark, monkeypatch):
    from docweir.llm.common import drop_table, shared_dir, stored

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = stored(spark.range(5), "t")
    assert table.count() == 5 and table.inputFiles()[0].startswith(spark.conf.get("spark.checkpoint.dir"))
    drop_table(table)
    with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        spark.read.parquet(table.inputFiles()[0] if table.inputFiles() else f"{shared_dir(spark)}/gone").count()
