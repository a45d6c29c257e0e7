"""Seconds per query on one machine.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every query is computed in full into a sink that keeps nothing. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marquee import session  # noqa: E402
from marquee.catalog import QUERIES  # noqa: E402
from marquee.plans.lineage import release  # noqa: E402

HEADLINE = [
    "scan_ratings",
    "ratings_between",
    "mixed_samples",
    "user_history_slots",
    "user_window_stats",
    "user_genre_slots",
    "user_features_latest",
    "movie_features_latest",
    "user_feature_kv",
    "movie_features",
    "movie_features_joined",
    "ratings_with_movies",
    "rating_distribution",
    "user_rating_stats",
    "movie_top_ratings",
    "user_genre_ranked",
    "genre_index",
    "word_count",
    "rating_lookup",
    "watchlist_latest",
    "watchlist_flags",
    "ranking_features",
    "top_movies_by_rating",
    "top_movies_per_genre",
    "rec_list_pages",
    "user_recent_ratings",
    "item_sequences",
    "item_pair_counts",
    "transition_matrix",
    "item_distribution",
    "random_walks",
    "item_cosine_pairs",
    "similar_movies_genre",
    "similar_movies_embedding",
    "multi_recall",
    "user_embeddings",
    "user_rank_embedding",
    "history_attention_pool",
    "multi_hot_genres",
    "cross_counts",
    "numeric_features",
    "split_by_time",
    "baseline_rmse",
    "auc_rank_sum",
    "als_user_recs",
    "als_item_recs",
    "als_cv",
    "item2vec_vectors",
    "graph_embedding",
    "wide_lr_metrics",
    "fm_metrics",
    "mlp_metrics",
    "user_rank_two_tower",
    "user_rank_model",
    "stream_latest_rating",
    "stream_late_rows",
    "ratings_upserted",
    "watchlist_snapshot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session.local(int(os.environ.get("BENCH_CPUS", "8")), os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    # one unmeasured run loads and compiles what every query uses
    QUERIES["mixed_samples"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    release(spark)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
