import collections
import random

from pyspark.sql import functions as F

from marquee.operators import graph, models, samples, splits
from marquee.plans.skew import LONG_SEQUENCE


def test_sequences_are_cut_into_segments(make_ratings, monkeypatch):
    monkeypatch.setattr(graph, "SEQUENCE_ROWS", 4)
    ratings = make_ratings([(1, m, 4.0, 100 - m) for m in range(10)] + [(2, 5, 1.0, 1)])
    out = graph.item_sequences(ratings).orderBy("segment").collect()
    assert [r.sequence for r in out] == ["9 8 7 6", "5 4 3 2", "1 0"]


def test_pairs_probabilities_and_starts(make_ratings):
    ratings = make_ratings(
        [(u, m, 5.0, t) for u in (1, 2) for t, m in enumerate((10, 20, 30))]
        + [(3, m, 5.0, t) for t, m in enumerate((10, 30))]
        + [(3, 20, 1.0, 9)]
    )
    counts = graph.pair_counts(graph.item_pairs(ratings))
    edges = {(r.src, r.dst): (r.cnt, r.prob) for r in graph.transition_matrix(counts).collect()}
    assert edges == {(10, 20): (2, 2 / 3), (10, 30): (1, 1 / 3), (20, 30): (2, 1.0)}
    starts = {r.movieId: r.prob for r in graph.item_distribution(counts).collect()}
    assert starts == {10: 3 / 5, 20: 2 / 5}


def test_walks_follow_edges_and_stop(spark):
    arcs = [(1, 2)] * 6 + [(1, 3)] * 2 + [(2, 1)] * 5 + [(3, 4)] * 3
    pairs = spark.createDataFrame(
        [(u, s, d) for u, (s, d) in enumerate(arcs)], "userId int, src int, dst int"
    )
    out = graph.random_walks(pairs, walks=4000, length=6).collect()
    assert len(out) == 4000 and len({r.walk for r in out}) == 4000
    known = set(arcs)
    steps = collections.Counter()
    for r in out:
        assert 1 <= len(r.nodes) <= 6
        assert all(e in known for e in zip(r.nodes, r.nodes[1:]))
        # a walk is short only where it cannot go on
        assert len(r.nodes) == 6 or r.nodes[-1] == 4
        steps.update(zip(r.nodes, r.nodes[1:]))
    share = steps[(1, 2)] / (steps[(1, 2)] + steps[(1, 3)])
    assert abs(share - 0.75) < 0.03
    first = collections.Counter(r.nodes[0] for r in out)
    assert abs(first[1] / 4000 - 8 / 16) < 0.04
    assert first[4] == 0


def test_alias_slots_hold_the_exact_weights(spark):
    """Summed over a key's slots, every item has n times its weight; hot, tied and lone items too."""
    rnd = random.Random(3)
    weights = {k: [rnd.choice([1, 1, 2, 7, 400]) for _ in range(n)] for k, n in enumerate((1, 2, 3, 17, 300))}
    weights[9] = [5] * 8
    weights[10] = [10**15, 1, 1]
    rows = [(k, i, w) for k, ws in weights.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "k int, i int, w bigint")
    held, slots = collections.Counter(), collections.defaultdict(set)
    for r in graph.alias_table(df, "k", "i", "w").collect():
        assert 0 < r.keep <= r.total == sum(weights[r.k]) and r.n == len(weights[r.k])
        slots[r.k].add(r.slot)
        held[r.k, r["item"]] += r.keep
        if r.keep < r.total:
            held[r.k, r.other] += r.total - r.keep
    assert held == {(k, i): w * len(weights[k]) for k, i, w in rows}
    assert all(slots[k] == set(range(len(ws))) for k, ws in weights.items())
    # n times the total is beyond 64 bits
    huge = spark.createDataFrame([(0, i, 2**60 + i % 2) for i in range(7)], "k int, i int, w bigint")
    held.clear()
    for r in graph.alias_table(huge, "k", "i", "w").collect():
        held[r["item"]] += r.keep
        held[r.other] += r.total - r.keep
    assert all(held[i] == 7 * (2**60 + i % 2) for i in range(7))


def test_long_walks_are_written_on_the_way(spark, monkeypatch):
    arcs = [(0, 1, 2), (1, 2, 1), (2, 1, 3), (3, 3, 4)]
    pairs = spark.createDataFrame(arcs, "userId int, src int, dst int")
    whole = graph.random_walks(pairs, walks=50, length=7)
    monkeypatch.setattr(graph, "PLAN_STEPS", 2)
    cut = graph.random_walks(pairs, walks=50, length=7)
    wanted = sorted((r.walk, tuple(r.nodes)) for r in whole.collect())
    assert sorted((r.walk, tuple(r.nodes)) for r in cut.collect()) == wanted
    # walks too many to be copied meet the slots by key
    apart = graph.random_walks(pairs, walks=50, length=7, broadcast_bytes=0)
    assert sorted((r.walk, tuple(r.nodes)) for r in apart.collect()) == wanted


def test_walks_depend_on_the_seed_only(inputs):
    pairs = inputs.pairs

    def walk(seed, n):
        rows = graph.random_walks(pairs.repartition(n), walks=300, seed=seed).collect()
        return {r.walk: tuple(r.nodes) for r in rows}

    assert walk(7, 3) == walk(7, 5)
    assert walk(7, 3) != walk(8, 3)


def test_no_pairs_no_walks(spark):
    pairs = spark.createDataFrame([], "userId int, src int, dst int")
    assert graph.random_walks(pairs, walks=5).count() == 0


def test_hashing_finds_the_vector_itself(inputs):
    row = inputs.embeddings.where("movieId = 17").first()
    near = models.nearest_by_hashing(inputs.embeddings, [float(x) for x in row.emb]).collect()
    best = min(near, key=lambda r: r.distance)
    assert (best.movieId, round(best.distance, 6)) == (17, 0.0)


def test_als_and_two_towers(inputs):
    train, test = splits.hash_split(inputs.ratings)
    model = models.als(train).fit(train)
    assert model.transform(test).where("isnan(prediction)").count() == 0
    recs = models.flat_recommendations(model.recommendForAllUsers(10), "userId", "movieId")
    sizes = recs.groupBy("userId").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(sizes) == (10, 10)
    scores = models.two_tower_scores(model, test.select("userId", "movieId"))
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low < high <= 1


def test_click_models_learn(make_ratings, make_movies):
    """A genre that is always liked and one that never is."""
    ratings = make_ratings(
        [(u, m, 5.0 if m % 2 else 1.0, (u * 7 + m * 13) % 50) for u in range(30) for m in range(20)]
    )
    movies = make_movies([(m, f"M ({1990 + m})", "Good" if m % 2 else "Bad") for m in range(20)])
    rows = samples.mixed_samples(ratings, movies, LONG_SEQUENCE).cache()
    train, test = splits.hash_split(rows)
    from marquee.operators.evaluation import classification_metrics

    for fit in (models.wide_model, models.fm_model, models.mlp_model):
        found = classification_metrics(models.score(fit(train), test))
        assert found["accuracy"] > 0.9, fit.__name__
        assert found["rocAuc"] > 0.95, fit.__name__


def test_quantiles_of_many_columns(spark):
    rows = [(i * 7919 % 10_007, float(i % 3), None) for i in range(10_007)]
    df = spark.createDataFrame(rows, "a int, b double, c int").repartition(9)
    found = splits.approx_quantiles(df, ["a", "b", "c"], [0.1, 0.5, 0.99], 0.01)
    ranked = {(r.column, r.share): r for r in splits.rank_errors(df, found).collect()}
    assert len(ranked) == 9
    for (column, share), r in ranked.items():
        if column == "c":
            assert (r.rows, r.value, r.error) == (0, None, None)
        else:
            assert r.rows == len(rows) and r.error <= 0.01
    assert abs(ranked["a", 0.5].value - 5_003) <= 101
    far = found.withColumn("value", F.col("value") + 600)
    errors = {(r.column, r.share): r.error for r in splits.rank_errors(df, far).collect()}
    assert errors["a", 0.5] > 0.05


def test_splits_are_whole_and_disjoint(inputs):
    n = inputs.ratings.count()
    for train, test in (
        splits.random_split(inputs.ratings, 3),
        splits.hash_split(inputs.ratings),
        splits.split_by_time(inputs.ratings),
        splits.split_by_time(inputs.ratings, exact=True),
    ):
        assert train.count() + test.count() == n
        assert abs(train.count() / n - 0.8) < 0.06
        assert train.join(test, ["userId", "movieId"], "left_semi").count() == 0
