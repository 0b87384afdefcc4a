"""Times the headline queries.  BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "module_edges_a3_j3_j4_u1", "file_graph_edges_a4", "most_referenced_a5", "repository_stats_a9", "neighbours_j1",
    "impact_summary_a8_u2", "call_edges_e7_e8", "import_edges_e6", "vector_neighbours_t1", "document_search_t2", "symbol_matches_j9",
    "hybrid_search_c2_w2", "evidence_sources_c3", "file_chunks_g1_g2_g3", "uncovered_lines_g5", "verified_answers_c5",
    "definitions_x1_to_x6_x9_to_x12_x14", "import_specifiers_x7", "index_corpus_c1", "postings_t2", "related_entities_a13",
    "stemmed_search_t2", "pruned_search_t2", "symbols_by_needle_p20_t3", "module_entities_g5",
)


def main() -> None:
    from codestrata.queries import load_all
    from codestrata.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    wanted = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    times = {}
    for name in wanted:
        start = time.time()
        queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
