"""Operators on documents against brute force: nulls, empty and very long texts, repeated rows, clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ionframe.llm import bpe, common, minhash, packing, prefixes, sharding, substrings, toxicity, wordbpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, size long, shard int, start long, node long, component string, text_key string, spans int"


def prose(seed: int, n: int, syllables: str = "an er on to re ka mi") -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(syllables.split(), rng.integers(1, 4))) for _ in range(n))


BASE, OTHER = prose(1, 120), prose(2, 90)
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE + " a few words more"), (4, OTHER), (5, prose(3, 60) + " " + " ".join(BASE.split()[20:85]) + " end"),
    (6, None), (7, ""), (8, " \n\t "), (None, BASE), (None, None), (9, "Two words"), (10, "two  WORDS"), (11, "It's 'll 've  <|endoftext|> ok so\x1cit"),
    (12, "Straße ΑΣ İ é é 中文 😀"), (4, prose(4, 55)), (13, prose(5, 30_000)), (14, "a " * 300), (15, "a " * 320), (0, OTHER.upper()),
    (16, "x" * 5000), (17, prose(5, 30_000)[:-9]),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 1, 0, 5, "c", "k", 3) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS).cache()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_words_follow_the_rule():
    for _, text in TEXTS:
        assert common.words(text) == common.WORD.findall(text or "")
    assert common.words("a\x1cb c\x0bd") == ["a\x1cb c", "d"]
    assert common.ascii_lower("ÀBK") == "ÀbK"


def test_cache_is_bounded():
    calls = []
    cache = common.Cache(lambda k: calls.append(k) or k.upper(), size=4, longest=3)
    for k in ["a", "b", "c", "d", "e", "a", "long one", "long one"]:
        assert cache[k] == k.upper()
    assert len(cache) <= 4 and calls.count("long one") == 2 and calls.count("a") == 1


# Packing


@given(st.integers(0, 50_000))
def test_cuts_are_powers_of_two(n):
    cuts = list(packing.cuts(n))
    assert [s for s, _ in cuts] == list(np.cumsum([0, *[k for _, k in cuts]])[:-1]) and sum(k for _, k in cuts) == n
    assert all(k & (k - 1) == 0 and k <= 4096 for _, k in cuts)


def test_packing_keeps_each_id_once(spark, docs):
    got = packing.pack(docs, WORD_FILE, 2).collect()
    library = Tokenizer.from_file(WORD_FILE)
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    pieces = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length == 1 << r.bucket <= 4096 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id].append((r.start, r.doc_tokens, tuple(ids)))
    want = defaultdict(list)
    for key, text in TEXTS:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want[key] += [(s, len(ids), tuple(ids[s : s + n])) for s, n in packing.cuts(len(ids))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}


def test_buckets_hold_one_length(spark, docs, tmp_path):
    sequences = packing.pack(docs, WORD_FILE, 2)
    packing.write_buckets(sequences, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == sequences.count() and back.where("length != power(2, bucket)").count() == 0


# BPE


def test_encoding_and_decoding_equal_the_library(spark, docs):
    library = Tokenizer.from_file(WORD_FILE)
    want = []
    for key, text in TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((key, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert rows_of(bpe.digests(docs, WORD_FILE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    decoded = bpe.decode(bpe.encode(docs, WORD_FILE), WORD_FILE)
    assert {r.decoded for r in decoded.where("doc_id = 9").collect()} == {"two</w> words</w>"}


ODD = st.lists(
    st.sampled_from([*"abcdeinrst AEIΣ'.,!0 \n\t", "é", "e\u0301", "ß", "İ", "中", "😀", "\u3000", "\x1c", "<|endoftext|>", "<|"]), max_size=60
).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_merging_any_text_equals_the_library(text):
    ids = _library(WORD_FILE).encode(text, add_special_tokens=False).ids
    assert wordbpe.unpacked(wordbpe.encoder(WORD_FILE).encode(text)).tolist() == ids
    assert wordbpe.unpacked(wordbpe.library_encoder(WORD_FILE).encode(text)).tolist() == ids


def _library(path, known={}):
    return known.setdefault(path, Tokenizer.from_file(path))


# Token counts


@settings(max_examples=150, deadline=None)
@given(ODD)
def test_every_prefix_has_its_exact_count(text):
    steps, library = prefixes.counter(BYTE_FILE).steps(text), _library(BYTE_FILE)
    counts = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert [prefixes.count_at(steps, k) for k in range(len(text) + 1)] == counts
    for budget in (0, 1, 5):
        assert prefixes.cut_at(steps, budget) == max(k for k, c in enumerate(counts) if c <= budget)


def test_counts_of_documents_and_truncation(spark, docs):
    library = Tokenizer.from_file(BYTE_FILE)
    counted = prefixes.prefix_counts(docs, BYTE_FILE)
    want = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in TEXTS]
    assert rows_of(counted, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    cut = prefixes.truncate(docs.where("doc_id in (1, 6, 13)"), counted.where("doc_id in (1, 6, 13)"), 50).collect()
    for row in cut:
        whole = dict(TEXTS)[row.doc_id]
        if whole is None:
            assert row.text is None and row.n_tokens == 0
        else:
            assert whole.startswith(row.text) and row.n_tokens == len(library.encode(row.text).ids) <= 50 < len(library.encode(whole).ids)


# Sharding


def test_shards_are_gapless_and_grow_into_the_new_one(spark, docs):
    many = docs.unionByName(frame(spark, [(i, f"text {i % 700}") for i in range(100, 3100)]))
    got = sharding.shard_documents(many, sharding.equal_shards(8), (8, 1.0), cells=16).collect()
    assert len(got) == len(TEXTS) + 3000
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in many.collect()
    )
    by_shard, of_key = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r.shard].append(r.slot)
        of_key[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) == set(range(8))
    assert all(len(v) == 1 for v in of_key.values())
    assert 0.08 < sum(r.grown_shard == 8 for r in got) / len(got) < 0.15


def test_weights_and_one_shard(spark):
    from pyspark.sql import functions as F

    keys = spark.range(6000)
    share = Counter(r.s for r in keys.select(sharding.shard_of(F.col("id"), [(3, 1.0), (5, 3.0)]).alias("s")).collect())
    assert 0.7 < share[5] / 6000 < 0.8
    assert keys.select(sharding.shard_of(F.col("id"), [(3, 1.0)]).alias("s")).distinct().count() == 1
    for bad in ([], [(1, 0.0)], [(1, 1.0), (1, 1.0)]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.col("id"), bad)


# Near-duplicates


def shingles(text):
    words = common.WORD.findall(common.ascii_lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_components(texts):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(texts):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [(k, len(sets[i]), least.get(root(i)) if sets[i] else k, (k == least.get(root(i))) if sets[i] else True) for i, (k, _) in enumerate(texts)]


def near_copies(n):
    """Copies of one text with words replaced here and there: some pairs are linked only through others."""
    rng, out = np.random.default_rng(9), []
    for i in range(n):
        words = BASE.split()
        for at in rng.integers(0, len(words), rng.integers(1, 4)):
            words[at] = f"w{i}_{at}"
        out.append((1000 + i, " ".join(words)))
    return out


def test_near_duplicates_equal_all_pairs(spark, docs):
    got = minhash.near_duplicates(docs)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(near_components(TEXTS), key=repr)
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect())[1] == 1 and kept.where("doc_id in (2, 3)").count() == 0
    assert kept.where("doc_id in (6, 7, 8)").count() == 3


def test_a_large_group_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SETS", 8)
    texts = [*near_copies(70), *[(i, prose(i, 40) + " " + OTHER) for i in range(40)]]
    got = minhash.near_duplicates(frame(spark, texts))
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(near_components(texts), key=repr)


# Substrings


def without_windows(texts, window=50):
    first = {}
    words = [common.WORD.findall(t or "") for _, t in texts]
    for (key, _), w in zip(texts, words):
        for i in range(len(w) - window + 1):
            if key is not None:
                first[tuple(w[i : i + window])] = min(key, first.get(tuple(w[i : i + window]), key))
    out = []
    for (key, _), w in zip(texts, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if key is not None and first[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_passages_equal_all_windows(spark, docs):
    assert rows_of(substrings.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == without_windows(TEXTS)
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    texts = {r.doc_id: r.text for r in cut.where("doc_id in (1, 3, 6, 8, 12)").collect()}
    before = dict(TEXTS)
    assert all(texts[k] == before[k] for k in (1, 6, 8, 12)) and texts[3] == "a few words more"


def test_repeated_passages_in_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD", 3)
    common_passage = prose(77, 64)
    texts = [*near_copies(25), *[(i, f"{prose(i, 30)} {common_passage} {prose(-i + 500, 30)}") for i in range(25)]]
    assert rows_of(substrings.digests(frame(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256") == without_windows(texts)


def test_runs_of_a_frequent_line_do_not_meet_in_one_automaton(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD", 8)
    held, by_automata = [], substrings.first_holders
    monkeypatch.setattr(substrings, "first_holders", lambda frame, *more: held.append(frame) or by_automata(frame, *more))
    line = prose(78, 45)
    texts = [(i, f"{prose(i, 40)} {line} {prose(300 - i // 2, 40)}") for i in range(60)]
    texts += [(100 + i, f"{prose(i, 20)} {line}") for i in range(3)] + [(5, f"{line} {prose(7, 30)}")]
    assert rows_of(substrings.digests(frame(spark, texts)), "doc_id", "n_words", "n_removed", "kept_sha256") == without_windows(texts)
    per_anchor = held[0].groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert per_anchor is None or per_anchor <= 8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), min_size=1, max_size=5), st.lists(st.integers(0, 2), max_size=20), st.integers(1, 4))
def test_automaton_finds_the_smallest_document(texts, query, window):
    automaton = substrings.SuffixAutomaton()
    for number, text in enumerate(texts):
        automaton.add(text, -number)
    automaton.close()
    holders = defaultdict(list)
    for number, text in enumerate(texts):
        for i in range(len(text) - window + 1):
            holders[tuple(text[i : i + window])].append(-number)
    want = [min(holders[tuple(query[i : i + window])], default=None) for i in range(len(query) - window + 1)]
    assert automaton.firsts(query, window) == want


# Empty tables


def test_empty_tables(spark):
    none = frame(spark, TEXTS[:1]).limit(0)
    for made in (
        packing.pack(none, WORD_FILE, 2), bpe.digests(none, WORD_FILE), prefixes.prefix_counts(none, BYTE_FILE),
        sharding.shard_documents(none, sharding.equal_shards(8)), minhash.near_duplicates(none), minhash.one_of_each(none),
        substrings.digests(none), substrings.without_repeats(none),
    ):
        assert made.count() == 0


def test_alike_nodes_are_brought_together_by_few_pairs(spark):
    """Members of one key that are all alike give fewer pairs than there are members, not all pairs."""
    n = 40
    classes = spark.createDataFrame([(i, 10, bytes(48)) for i in range(n)], "node long, n_shingles long, signature binary")
    members = spark.createDataFrame([(7, i, n) for i in range(n)], "key long, node long, members long")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "node long, component long")
    pairs = minhash.cross_pairs(members, classes, labels)
    assert pairs.count() < n
    joined = {r.node: r.component for r in minhash._joined(labels, pairs).collect()}
    assert joined == dict.fromkeys(range(n), 0)


def sizes_seen(df):
    """The bytes of the largest batch that a Python worker got of a frame, as a frame."""
    return df.mapInArrow(lambda batches: iter([pa.record_batch([pa.array([max(b.nbytes for b in batches)])], names=["n"])]), "n long")


def test_workers_get_small_batches_where_sets_are_made(spark, monkeypatch):
    """With Spark's 10,000 rows at a time a task holds them whole in direct memory and in its worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, long = spark.conf.get(key), spark.range(0, 6_000, 1, 1).select(F.repeat(F.lit("x"), 2_000).alias("text"))
    assert common.staged(sizes_seen(long), common.BATCH).first()["n"] < 1.5 * common.BATCH
    assert spark.conf.get(key) == before
    spark.conf.set(key, "1m")
    try:
        assert common.staged(sizes_seen(long), common.BATCH).first()["n"] < 1.5 * (1 << 20)
        common.set_batches(spark)
        assert common._in_bytes(spark.conf.get(key)) == 1 << 20
    finally:
        spark.conf.set(key, before)
    assert [common._in_bytes(x) for x in ("4194304", "64m", "67108864b", "2 KB", "0")] == [1 << 22, 1 << 26, 1 << 26, 2048, 1 << 31]
    seen, write = {}, common.staged
    monkeypatch.setattr(common, "staged", lambda df, batch=None: seen.update({tuple(df.columns): batch}) or write(df, batch))
    minhash.near_duplicates(frame(spark, TEXTS[:6])).collect()
    assert seen[("node", "shingles")] == seen[tuple(minhash._SKETCH.names)] == seen[("a", "b")] == common.BATCH


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """Workers stay for the tasks to come, so two in one task are twice as many from then on."""
    plans, search = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or search(links))
    minhash.near_duplicates(frame(spark, TEXTS[:6])).collect()
    assert len(plans) == 5 and not any("MapInArrow" in plan for plan in plans)


def test_small_memory_leaves_no_tokenizer(spark, docs):
    few = docs.where("doc_id < 6").coalesce(1)
    small = packing.pack(few, WORD_FILE, 2, keep_memory=False)
    held = small.groupBy().count().coalesce(1).mapInArrow(
        lambda batches: iter([pa.record_batch([pa.array([wordbpe.load.cache_info().currsize], pa.int64())], names=["n"]) for _ in batches]), "n long"
    )
    wordbpe.library_encoder(WORD_FILE)
    wordbpe.unload()
    assert [f.cache_info().currsize for f in (wordbpe.load, wordbpe.encoder, wordbpe.library_encoder)] == [0, 0, 0]
    assert held.first()["n"] == 0
    assert sorted(small.drop("sequence_id").collect()) == sorted(packing.pack(few, WORD_FILE, 2).drop("sequence_id").collect())


def test_cutting_and_scoring_by_small_parts(spark, monkeypatch):
    """Parts of a batch are scored and cut as the whole batch is; nulls and empty texts too."""
    model = toxicity.Model(-1.0, {f: 0.5 for f in toxicity.features_of("korean")})
    texts = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "korean", "x korean! y", "z"] * 50)], "doc_id long, text string").coalesce(1)
    want = {k: toxicity.sigmoid(model.margin(set(toxicity.document_features(t).tolist()) & set(model.weights))) for k, t in texts.collect()}
    monkeypatch.setattr(toxicity, "SLICE", 1)
    got = texts.select("doc_id", toxicity.score(model, F.col("text")).alias("score")).collect()
    assert {k: pytest.approx(v, abs=1e-12) for k, v in got} == want
