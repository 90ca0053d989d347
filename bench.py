"""Headline timings, one JSON line on standard output.

Tables are read from ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``. Every query runs
once to warm up and then ``$BENCH_RUNS`` times; the best time counts. Setting up
(the compiled and track tables, as an earlier job would leave them) is not timed,
nor are results moved to the driver: they go to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalogforge.operators import browse, dedup, entities, parsing, search, tracks
from catalogforge.operators.ordering import global_positions
from catalogforge.session import local_session, stage
from catalogforge.sources import exports
from catalogforge.sources.schema import CONTENT
from checks.source import MAX_YEAR, catalog_src, export_lines, table


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, spark__sql__shuffle__partitions=cpus)

    compiled = stage(catalog_src(spark, sf_dir).repartition(cpus), "compiled")
    lines = stage(export_lines(spark, sf_dir).repartition(cpus), "lines")
    rows = stage(tracks.build_tracks(compiled, max_year=MAX_YEAR), "tracks")
    documents = stage(table(spark, sf_dir, "documents").repartition(cpus), "documents")

    def parsed():
        return parsing.parse_lines(
            exports.lines_from_table(lines, "source_path", "line_no", "line")
        )

    def deduped():
        run = parsed()
        return run.lineage_of(dedup.dedup_first(run.rows, CONTENT, "seq"))

    queries = {
        "parse_exports": lambda: parsed().rows,
        "dedup_exports": deduped,
        "dedup_texts": lambda: dedup.dedup_first(documents, ["text"], "doc_id"),
        "clean_tracks": lambda: tracks.clean_tracks(compiled, max_year=MAX_YEAR),
        "build_tracks": lambda: tracks.build_tracks(compiled, max_year=MAX_YEAR),
        "artist_index": lambda: entities.artist_index(rows),
        "album_index": lambda: entities.album_index(rows),
        "album_artists": lambda: entities.entity_members(rows, "albumSlug", "artist"),
        "collection_stats": lambda: entities.collection_stats(rows),
        "extract_artists": lambda: entities.extract_artists(compiled),
        "artist_detail": lambda: browse.artist_detail(rows),
        "album_detail": lambda: browse.album_detail(rows),
        "album_tracks": lambda: browse.album_tracks(rows),
        "site_pages": lambda: browse.paginate(rows, browse.site_order()),
        "chunk_documents": lambda: tracks.chunk_documents(rows),
        "text_order": lambda: global_positions(
            documents.select("doc_id", "text"), ["text", "doc_id"]
        ),
        "keyword_postings": lambda: search.keyword_postings(documents, "doc_id", "text"),
    }
    times = {}
    for name, query in queries.items():
        best = None
        for _ in range(runs + 1):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None or took < best else best
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
