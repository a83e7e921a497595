"""Corpus operators against brute force, on small tables with odd rows."""

import zlib

import numpy as np
import pytest

from quernstone.llm import entropy_mix, language, length_buckets, licence, near_dedup, quality, stream_dedup, tiff, token_prefix, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, keep string, page string"
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, "a b c", "en", "s1", 5, "x", "p"),
    (2, "a b c", "en", "s1", 5, None, None),
    (2, "a b c", "en", None, None, None, None),
    (None, "a b c", None, "s2", 5, None, None),
    (4, None, "en", "s2", None, None, None),
    (5, "", "fr", "s3", 0, None, None),
    (6, BASE, "fr", "s3", 1, None, None),
    (7, BASE + " more", "de", "s1", 1, None, None),
    (8, "é" * 5000, None, "s1", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_keeps_one_row_of_each_text(spark, docs, empty):
    found = stream_dedup.decide(spark, docs).collect()
    assert len(found) == len(ROWS)
    assert sum(r.kept for r in found) == len({r[1] or "" for r in ROWS})
    assert {(r.keep.id, r.group_size) for r in found if r.id == 1} == {(2, 4)}
    assert stream_dedup.decide(spark, empty).count() == 0
    assert stream_dedup.deduplicated(spark, docs).columns == docs.columns


def test_exact_dedup_compares_full_bytes_where_digests_clash(spark, docs):
    found = stream_dedup.decide(spark, docs, digest=lambda t: (t == "").cast("string")).collect()
    assert {(r.id, r.group_size) for r in found if r.kept} == {(2, 4), (5, 2), (6, 1), (7, 1), (8, 1)}


def test_near_dedup_links_alike_texts_only(spark, docs, empty):
    found = near_dedup.grouped(spark, docs, k=3, percent=85).collect()
    assert len(found) == len(ROWS)
    components = {r.id: r.component for r in found if r.id is not None}
    assert components == {1: 1, 2: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    assert sum(r.first for r in found) == 5
    assert near_dedup.grouped(spark, empty).count() == 0


def test_mix_reaches_targets_within_the_cap(spark, docs, empty):
    found = entropy_mix.mixed(spark, docs).collect()
    assert len(found) == len(ROWS) and all(0 <= r.copies <= 3 for r in found)
    targets = {r.source: r.target for r in found}
    assert abs(sum(targets.values()) - sum(r.size for r in found)) < 1e-6
    assert entropy_mix.mixed(spark, empty).count() == 0


def test_boundaries_are_optimal():
    from itertools import combinations

    lengths, counts = [1, 3, 4, 9, 10, 17], [5, 1, 7, 2, 2, 1]

    def padding(ends):
        return sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts, strict=True))

    best = min(padding((*c, 17)) for c in combinations(lengths[:-1], 2))
    assert padding(length_buckets.boundaries(lengths, counts, 3)) == best


def _least_padding(lengths, counts, buckets):
    """The quadratic dynamic program, over every pair of lengths."""
    x, n = np.array(lengths), np.concatenate(([0], np.cumsum(counts)))
    total = np.concatenate(([0], np.cumsum(x * counts)))
    best = np.concatenate(([0], x * n[1:] - total[1:]))
    for _ in range(buckets - 1):
        best = np.array([0, *((best[:j] + x[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])).min() for j in range(1, len(x) + 1))])
    return best[-1]


def test_boundaries_match_the_quadratic_program():
    random = np.random.default_rng(5)
    for size in (1, 2, 7, 8, 33, 300):
        lengths, counts = np.sort(random.choice(3 * size, size, replace=False)).tolist(), random.integers(1, 9, size).tolist()
        for buckets in (1, 2, 5, 400 if size < 300 else 16):
            ends = length_buckets.boundaries(lengths, counts, buckets)
            assert len(ends) <= buckets and ends == sorted(set(ends)) and ends[-1] == lengths[-1]
            padding = sum(n * (ends[np.searchsorted(ends, x)] - x) for x, n in zip(lengths, counts, strict=True))
            assert padding == _least_padding(lengths, counts, min(buckets, size))


def test_many_lengths_are_not_coarsened_by_a_long_text(spark):
    rows = spark.range(2200).selectExpr("id as doc_id", "repeat('a ', cast(if(id = 2199, 100000, 1 + id) as int)) as text")
    found = length_buckets.packed(spark, rows).toPandas()
    lengths = [*range(1, 2200), 100000]
    assert sorted(found.length) == lengths
    assert (found.padded - found.length).sum() == _least_padding(lengths, [1] * 2200, 16)


def test_batches_have_no_gaps(spark, docs, empty):
    found = length_buckets.packed(spark, docs, buckets=2, budget=100).toPandas()
    assert len(found) == len(ROWS)
    for _, batch in found.groupby(["bucket", "batch"]):
        assert sorted(batch.slot) == list(range(len(batch))) and set(batch.batch_rows) == {len(batch)}
    assert length_buckets.packed(spark, empty).count() == 0


@pytest.mark.parametrize("codec", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
def test_tiff_round_trip(codec, tile):
    pages = [np.random.default_rng(3).integers(0, 7, (50, 33), dtype=np.uint8), np.zeros((5, 200, 3), np.uint8)]
    for predictor in (1, 2):
        read = list(tiff.read_tiff(tiff.write_tiff(pages, codec, predictor, tile)))
        assert [p["data"] for p in read] == [p.tobytes() for p in pages]
    assert [p["error"] for p in tiff.read_tiff(None)] == ["no content"]
    assert next(tiff.read_tiff(b"II*\0\xff\0\0\0"))["error"]


def test_token_counts_match_the_library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    counter = token_prefix.PrefixCounter(token_prefix.vocabulary(path))
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    text = " Thé quick\n\n  brown 😀 fox <s> 中文 1234567 aaaaaaa\t▁x"
    assert token_prefix.counts_at(counter.deltas(text)).tolist() == [len(library.encode(text[: i + 1])) for i in range(len(text))]
    assert counter.deltas("") == b""


def test_licences_are_found_by_canonical_text(spark, docs, empty):
    text = "Copyright (c) 2020 Someone\n\n" + licence.LICENCES[0][1].upper().replace("SUBLICENSE", "sub-licence").replace(" ", "  ")
    rows = spark.createDataFrame([(1, text), (2, "x\nReleased under the MIT Licence!"), (3, None)], "doc_id bigint, text string")
    found = {r.id: (r.licence, r.notices) for r in licence.scanned(spark, rows).collect()}
    assert found == {1: ("MIT", ""), 2: (None, "MIT"), 3: (None, "")}
    assert licence.scanned(spark, empty).count() == 0 and licence.scanned(spark, docs).count() == len(ROWS)


def test_notices_are_found_whatever_their_words_and_spacing(spark):
    texts = ["x\nDedicated to the public-domain under CC0 1.0.", "Dedicated to the public  domain under CC0 1.0.\ny", "a\nGPLv3 only.", "public domain"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = lambda **kw: [r.notices for r in licence.scanned(spark, rows, **kw).orderBy("id").collect()]
    assert found() == ["CC0-1.0", "CC0-1.0", "", ""]
    assert found(texts=[("GPL-3.0", "GPLv3 only")]) == ["", "", "GPL-3.0", ""]


def test_classifiers_take_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    for module in (toxicity, quality):
        for rows in (docs, empty):
            scored = module.scored(rows, module.learn(rows, labels))
            assert scored.where("score between 0 and 1").count() == rows.count()
    found = {r.doc_id: r.mixture.lang for r in language.inferred(docs, language.learn(docs)).collect()}
    assert found[4] == found[5] == "und"
    assert language.inferred(empty, language.learn(empty)).count() == 0


def test_pairs_tell_where_no_term_does():
    random = np.random.default_rng(2)

    def rows(n):
        left, right = random.integers(0, 2, (2, n))
        fill = [" ".join(f"f{chr(97 + i)}" for i in random.choice(20, 3, replace=False)) for _ in range(n)]
        return [toxicity.terms(f"l{'xy'[a]} r{'xy'[b]} {f}") for a, b, f in zip(left, right, fill, strict=True)], (left == right).astype(float)

    terms, labels = rows(2000)
    machine = toxicity.fit(terms, labels, 1.0)
    terms, labels = rows(500)
    assert np.mean([(machine.logit(t) > 0) == y for t, y in zip(terms, labels, strict=True)]) > 0.95


def test_near_dedup_word_codes(monkeypatch):
    texts = ["a B c a b", "  x\ty ", "", "é É z", "w" * 40 + " q", "one"]
    whole = [near_dedup._word_codes(t.encode()).tolist() for t in texts]
    assert [len(w) for w in whole] == [len(t.encode().split()) for t in texts]
    for piece in (1, 3, 8):
        monkeypatch.setattr(near_dedup, "_PIECE", piece)
        assert [near_dedup._word_codes(t.encode()).tolist() for t in texts] == whole


def test_quality_is_fitted_on_all_pairs_of_all_rows():
    """Loss and gradient from bins are those of all pairs one by one, whatever the parts; the fit is their optimum."""
    random = np.random.default_rng(5)
    x, labels = random.normal(size=(400, 3)), random.integers(0, 2, 400)
    x[:, 0] += labels
    model = quality.Ranking(x.mean(0), x.std(0), random.normal(size=6), 0.0)

    def brute(model):
        z, w = model.inputs(x), model.weights
        gap = (z[labels == 1][:, None] - z[labels == 0][None]).reshape(-1, 6)
        lose = 1 / (1 + np.exp(gap @ w))
        return np.logaddexp(0, -(gap @ w)).mean() + 5e-5 * w @ w, -(gap * lose[:, None]).mean(0) + 1e-4 * w

    sums = lambda m: quality.added([quality.summed(x[a::7], labels[a::7], m) for a in range(7)])
    loss, gradient, _ = quality.pairs_loss(sums(model), model, 1e-4)
    want = brute(model)
    assert abs(loss - want[0]) < 1e-6 and np.abs(gradient - want[1]).max() < 1e-5
    best = quality.fit(model, sums)
    assert np.abs(brute(best)[1]).max() < 1e-5


def test_quality_learns_from_every_labelled_row(spark):
    """More rows than the former 6000 a class: the threshold is the exact quantile over all of them."""
    rows = spark.range(16000).selectExpr("id as doc_id", "concat(repeat('word ', cast(id % 97 as int)), id) as text")
    labels = rows.selectExpr("doc_id", "cast(doc_id % 97 > 60 or doc_id % 11 = 0 as int) as quality")
    model = quality.learn(rows, labels)
    kept = [i for i in range(16000) if zlib.crc32(str(i).encode()) % 5]
    raw = np.sort([float(model.raw(quality.features("word " * (i % 97) + str(i)))) for i in kept])
    n0 = sum(not (i % 97 > 60 or i % 11 == 0) for i in kept)
    assert n0 > 6000 and abs(model.shift + np.log(0.3 / 0.7) - (raw[n0 - 1] + raw[n0]) / 2) < 1e-12
