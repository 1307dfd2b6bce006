"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the number of cores. BENCH_QUERIES may
name other queries, separated by commas, or ``all``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loometric.queries import catalog  # noqa: E402
from loometric.session import local_session  # noqa: E402

HEADLINE = (
    "classification_report", "confusion_matrix_fixed", "confusion_matrix_seen", "ner_report", "label_distribution",
    "training_text", "render_chat", "filter_max_tokens", "write_splits", "normalize_prompts", "sample_exact",
    "align_labels", "mask_prompt", "pending_each", "pending_once", "common_prompts", "coverage", "leaderboard",
    "parse_structured_response", "rouge_n", "rouge_l", "corpus_bleu", "embedding_match", "pool_mean",
    "loss_cross_entropy", "decode_bio", "entity_overlap_scores", "extract_qa", "merge_subwords", "score_batches",
    "append_results", "score_stream", "train_text_classifier", "predict_classes", "match_entities",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = tuple(catalog.QUERIES) if asked == "all" else tuple(asked.split(",")) if asked else HEADLINE
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    # the first query also pays for starting Spark and its Python workers
    catalog.QUERIES["map_rows"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": int(cores),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
