"""Trained operators and vector search: brute force, held-out quality, odd rows."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from ionframe.llm import components, covertree, hmm, quantised, queries, toxicity
from pyspark.sql import functions as F

from llm.test_texts import TEXTS, frame, rows_of

SMALL = "/root/testdata/sf0.01"


# Language model


@pytest.fixture
def few_classes(monkeypatch):
    monkeypatch.setattr(hmm, "CLASSES", 5)


def test_recursions_equal_enumeration(few_classes):
    model, rng = hmm.first_model(np.ones(6) / 6, 3), np.random.default_rng(0)
    sequences = [np.append(rng.integers(0, 5, n), 5) for n in (3, 0, 5, 1, 4, 4)]
    strip = hmm.Strip(sequences)
    likely = strip.log10(strip.forward(model)[2], len(sequences))
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 6))
    for sequence, got in zip(sequences, likely):
        paths = {}
        for path in itertools.product(range(3), repeat=len(sequence)):
            p = model.start[path[0]] * model.emits[path[0], sequence[0]]
            for i in range(1, len(path)):
                p *= model.moves[path[i - 1], path[i]] * model.emits[path[i], sequence[i]]
            paths[path] = p
        total = sum(paths.values())
        assert math.isclose(got, math.log10(total), abs_tol=1e-9)
        for path, p in paths.items():
            starts[path[0]] += p / total
            for i, z in enumerate(path):
                emits[z, sequence[i]] += p / total
                if i:
                    moves[path[i - 1], z] += p / total
    for got, want in zip(strip.expected(model), (starts, moves, emits)):
        assert np.allclose(got, want)


def test_base_score_and_counts(spark):
    texts = [(i, t) for i, (_, t) in enumerate(TEXTS)] + [(None, "never seen zzz")]
    got = {r.doc_id: r for r in hmm.score(frame(spark, texts), states=3, rounds=2).collect()}
    split = lambda t: [w for w in (t or "").encode().lower().decode().translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in texts}
    counts = Counter(itertools.chain.from_iterable([*split(t), None] for k, t in texts if not held[k]))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for key, text in texts:
        tokens, row = [*split(text), None], got[key]
        assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (held[key], len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(row.base_score, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel_tol=1e-9)
        assert math.isfinite(row.score) and row.score < 0


def test_blocks_do_not_change_scores(spark):
    """Scores are sums over a text, however the texts are dealt."""
    texts = [(i, t) for i, (_, t) in enumerate(TEXTS)]
    one = {r.doc_id: r.score for r in hmm.score(frame(spark, texts).coalesce(1), states=2, rounds=1).collect()}
    many = {r.doc_id: r.score for r in hmm.score(frame(spark, texts).repartition(7), states=2, rounds=1).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)


def test_word_shares_sum_to_one():
    tokens, types = 40, 7
    whole = tokens + hmm.ADDED * (types + 1)
    assert math.isclose((tokens + hmm.ADDED * types) / whole + hmm.ADDED / whole, 1)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    got = queries.op2_hmm(spark, SMALL).where("held_out").collect()
    assert len(got) > 50 and sum(r.score for r in got) > sum(r.base_score for r in got)


# Toxicity


def test_risk_separates_from_positives_and_unlabelled_only():
    rng = np.random.default_rng(3)
    clean = lambda: np.unique(rng.integers(100, 400, 40))
    toxic = lambda: np.unique(np.append(clean(), rng.integers(0, 5, 2)))
    positive = [toxic().astype(np.int32) for _ in range(150)]
    unlabelled = [(toxic() if k % 10 == 0 else clean()).astype(np.int32) for k in range(600)]
    model = toxicity.fit(positive, unlabelled, 0.1)
    margin = lambda x: model.margin(set(x.tolist()) & model.weights.keys())
    assert sum(margin(toxic()) >= 0 for _ in range(200)) > 190 and sum(margin(clean()) >= 0 for _ in range(200)) < 10


def test_scores_do_not_see_held_out_labels(spark):
    documents, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = toxicity.score_documents(documents, labels)
    assert rows_of(one, "doc_id", "score") == rows_of(toxicity.score_documents(documents, changed), "doc_id", "score")
    joined = one.join(labels, "doc_id").where("held_out")
    hit = joined.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert hit > 0.9


def test_all_folds_teach_and_positives_have_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda positive, unlabelled, prior, features: seen.append((len(positive), len(unlabelled))) or toxicity.Model())
    texts = frame(spark, [(i, None if i % 3 else f"words {i}") for i in range(90)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, toxic int")
    assert toxicity.keep_clean(texts, labels, threshold=0.9).count() == 90
    toxicity.train(texts, labels, held_out=None, most_positive=12)
    assert seen == [(20, 30), (12, 30)]


def test_features_are_chosen_by_their_shares_in_all_texts(spark):
    texts = [f"all {'often ' * (i % 3 == 0)} {'bad ' * (i % 10 == 0)} own{i} {'rare ' * (i in (10, 20))}" for i in range(300)]
    positive = [toxicity.document_features(texts[i]) for i in range(0, 300, 10)]
    frame_ = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    counts = {f: 0 for t in texts for f in toxicity.document_features(t).tolist()}
    for t in texts:
        for f in toxicity.document_features(t).tolist():
            counts[f] += 1
    in_p = {f: sum(f in p for p in positive) for f in counts}
    value = {}
    for f in counts:
        a, b = in_p[f] / 30, counts[f] / 300
        m = max(a, b)
        value[f] = abs(a - b) / ((m * (1 - m) * (1 / 30 + 1 / 300)) ** 0.5 + 1e-12)
    for selected, surprise in ((4000, 4.0), (3, 0.5), (4000, 1.0)):
        want = sorted((f for f in value if value[f] >= surprise), key=lambda f: (-value[f], f))[:selected]
        got = toxicity.telling_features(frame_, positive, selected, surprise).tolist()
        assert got == want and toxicity.features_of("bad")[0] in got
    assert toxicity.features_of("rare")[0] not in toxicity.telling_features(frame_, positive).tolist()
    assert not len(toxicity.telling_features(frame_.limit(0), positive)) and not len(toxicity.telling_features(frame_, []))


def test_risk_and_its_step_by_plain_sums():
    """One round of the fit against the risk written out document by document and differentiated by differences."""
    rng = np.random.default_rng(5)
    positive = [np.unique(rng.integers(0, 6, 3)).astype(np.int32) for _ in range(12)]
    unlabelled = [np.unique(rng.integers(0, 6, 3)).astype(np.int32) for _ in range(20)]
    prior, every = 0.3, np.arange(6, dtype=np.int32)

    def risk(weights, bias):
        z = lambda x: bias + sum(weights[i] for i in x)
        mean = lambda side, sign: sum(np.log1p(np.exp(sign * z(x))) for x in side) / len(side)
        clean = mean(unlabelled, 1) - prior * mean(positive, 1)
        return prior * mean(positive, -1) + clean if clean >= 0 else -clean

    start = np.log(prior / (1 - prior))
    step = [risk(np.eye(6)[i] * 1e-6, start) - risk(np.eye(6)[i] * -1e-6, start) for i in range(6)]
    model = toxicity.fit(positive, unlabelled, prior, every, rounds=1, decay=0.0)
    # The first step of Adam goes against the gradient's sign by the rate.
    assert {f: round(w / 0.03, 2) for f, w in model.weights.items()} == {i: -np.sign(step[i]) for i in range(6)}


def test_toxicity_of_odd_rows(spark):
    documents = frame(spark, TEXTS)
    for labels in ("1L, 1", "null, 1", "5L, null"):
        key, value = labels.split(", ")
        marks = spark.sql(f"select cast({key} as bigint) doc_id, cast({value} as int) toxic")
        got = toxicity.score_documents(documents, marks).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = documents.limit(0)
    assert toxicity.score_documents(none, marks).count() == 0
    assert toxicity.keep_clean(documents, marks).columns == documents.columns


# Vectors

VECTORS = [
    (20, [1.0, 0.0, 0.5]), (40, [1.0, 0.0, 0.5]), (40, [0.99, 0.01, 0.5]), (1, [1.0, 0.0, 0.5]), (1, [1.0, 0.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, None),
    (4, [1.0, None, 0.5]), (5, [float("nan"), 0.0, 0.0]), (6, [float("inf"), 0.0, 0.0]), (7, []), (60, [-1.0, 0.0, -0.5]), (None, [1.0, 0.0, 0.5]),
    (8, [1e-300, 0.0, 5e-301]), (9, [1.0, 0.0]), (80, [0.5, 0.1]), (10, [-0.0, 0.0, 2.0]), (11, [3e5, -2e5, 1.0]),
]


def vectors(spark, rows):
    made = [(i, v, None if i == 20 and k else (k % 2), 0, "c", 1) for k, (i, v) in enumerate(rows)]
    return spark.createDataFrame(made, "vec_id long, embedding array<double>, label int, rank int, component string, node int").repartition(3)


def best_by_force(rows, k):
    floors = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a in floors:
        if i % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in floors if j != i and len(a) == len(b))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def test_top_k_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 3)) * 3
    more = [(100 + i, (centres[i % 6] + rng.normal(size=3) * 0.05).round(2).tolist()) for i in range(900)]
    monkeypatch.setattr(covertree, "BLOCK", 100)
    for rows in (VECTORS, VECTORS + more):
        got = covertree.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=4)
        assert rows_of(got, "query_id", "rank", "vec_id", "score") == best_by_force(rows, 4)
    assert covertree.top_k(vectors(spark, VECTORS).limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_of_a_block_are_dealt_and_pass_by_batches(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0]) for i in range(600)]
    monkeypatch.setattr(covertree, "BLOCK", 100)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 10)
    frames, dealt = [], covertree._dealt
    monkeypatch.setattr(covertree, "_dealt", lambda *given: frames.append(dealt(*given)) or frames[-1])
    got = covertree.top_k(vectors(spark, rows), F.col("vec_id") % 2 == 0, k=3)
    want = [r for r in best_by_force([(20 * i, v) for i, v in rows], 3) if r[0] % 40 == 0]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(((q // 20, r, v // 20, s) for q, r, v, s in want), key=repr)
    meet = frames[0].where("is_query").groupBy("to", "block", "part").count()  # about 43 queries go to each of 7 pivots
    assert meet.agg(F.max("count")).first()[0] <= 25

    columns = ("to", "block", "part", "is_query", "vec_id", "values", "node", "kth")
    taken = []

    def batches():
        for b in range(9):
            of = [(0, 0, 0, b > 1, 10 * b + i, np.array([i, b]).tobytes(), 10 * b + i, None) for i in range(10)]
            taken.append(b)
            yield pa.record_batch([pa.array(c, pa.float64() if n == "kth" else None) for n, c in zip(columns, zip(*of))], names=list(columns))

    answers = covertree._searched(batches(), 2)
    assert next(answers).num_rows == 20 and taken == [0, 1, 2]
    assert sum(a.num_rows for a in answers) == 6 * 20


def test_tree_covers_and_separates():
    points = np.random.default_rng(1).normal(size=(700, 2))

    def check(node):
        assert np.sqrt(((points[node.rows] - points[node.centre]) ** 2).sum(1)).max() <= node.radius + 1e-12
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            centres = points[[c.centre for c in node.children]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(len(centres)) * 9
            assert apart.min() > node.radius / 2 and max(c.radius for c in node.children) <= node.radius / 2
            [check(c) for c in node.children]

    check(covertree.build(points))


def test_scores_beyond_doubles_are_exact():
    rows = np.array([[2**31 + 1, 3], [2**31 - 1, 5]], np.int64)
    best = covertree.Search(rows, np.array([1, 2]), 2).run(rows, np.array([7, 1]), np.full(2, -np.inf))
    assert best[0][0].tolist() == [(2**31 + 1) ** 2 + 9, (2**31 + 1) * (2**31 - 1) + 15] and best[0][1].tolist() == [1, 2]
    assert best[1][0].tolist() == [(2**31 - 1) ** 2 + 25]


def linked_by_force(spark, rows):
    data = [(r.vec_id, r.embedding, r.label) for r in vectors(spark, rows).collect()]
    units = []
    for _, v, label in data:
        good = v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v) / np.abs(v).max() if good else None
        units.append(x / np.sqrt((x**2).sum()) if good else None)
    near = [[j for j in range(len(data)) if j != i and units[i] is not None and units[j] is not None and data[i][2] == data[j][2]
             and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.98] for i in range(len(data))]
    out = []
    for i, (key, _, _) in enumerate(data):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        least = min((data[j][0] for j in seen if data[j][0] is not None), default=None)
        out.append((key, len(near[i]), least, key == least))
    return sorted(out, key=repr)


def test_near_vectors_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 3))
    more = [(100 + i, (centres[i % 20] * rng.uniform(0.5, 2) + rng.normal(size=3) * 0.1).tolist()) for i in range(400)]
    monkeypatch.setattr(quantised, "BLOCK", 20)
    rows = [r for r in VECTORS + more]
    got = quantised.near_duplicates(vectors(spark, rows))
    assert rows_of(got, "vec_id", "n_links", "component_id", "kept") == linked_by_force(spark, rows)
    assert quantised.near_duplicates(vectors(spark, VECTORS).limit(0)).count() == 0


def test_recall_of_the_index(spark):
    """All pairs at the cosine are found on the small table."""
    table = pq.read_table(f"{SMALL}/embeddings.parquet")
    units = np.stack(table["embedding"].to_pylist()).astype(float)
    units /= np.sqrt((units**2).sum(1, keepdims=True))
    label = table["label"].to_numpy()
    want = int(((units @ units.T >= 0.98) & (label[:, None] == label[None, :])).sum()) - len(units)
    assert queries.op10_quantised(spark, SMALL).agg(F.sum("n_links")).first()[0] >= 0.9 * want


def test_components_of_paths_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 130), (130, 115), (115, 100), (200, 200), (41, 39)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert rows_of(got, "node", "component") == sorted([*((i, 0) for i in range(42)), (100, 100), (115, 100), (130, 100)], key=repr)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_small_slices(spark, monkeypatch):
    """Random links, a node with many smaller neighbours and one with many larger ones, cut into slices of a few links."""
    rng = np.random.default_rng(5)
    links = [*map(tuple, rng.integers(0, 400, (300, 2)).tolist()), *((2000, 1000 + i) for i in range(60)), *((500, 600 + i) for i in range(60))] * 2
    up = {x: x for pair in links for x in pair}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted(((x, root(x)) for x in up if any(x in p and p[0] != p[1] for p in links)), key=repr)
    monkeypatch.setattr(components, "SLICE", 7)
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    assert rows_of(components.components(frame), "node", "component") == want
    held = [pa.record_batch([pa.array([3, 3, 3]), pa.array([0, 1, 2])], names=["a", "b"])] * 4
    for by_node, sizes in ((True, [3]), (False, [3, 3])):
        assert [len(x) for x in components._slices_as_stars(held, by_node)] == sizes


def tasks_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
    return sum(told.getStageInfo(s).numCompletedTasks for s in stages)


def test_components_take_few_tasks(spark):
    """The driver keeps something of every task, so a round may deal its links only a few times."""
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for key, value in zip(kept, ("20", "false")):
            spark.conf.set(key, value)
        taken = tasks_of(spark, "components", lambda: components.components(links).collect())
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert taken < 650, taken
