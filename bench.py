"""Headline timings on one machine; prints one JSON line.

The driver's tables are first written as a warehouse (``build_star``), as a load does, and the
OLAP queries then run on the written tables. Three steps of the raw side run on records made
from the orders. Each entry is one full execution; a warm-up query is run before.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pubmart.operators import sample as S
from pubmart.plans import dashboard as D
from pubmart.plans import derived as V
from pubmart.plans import sessions
from pubmart.plans.attribution import FRACTIONAL, FULL, hierarchy_output
from pubmart.plans.filters import FilterState
from pubmart.plans.reconcile import place_policy, reconcile
from pubmart.session import build_session
from pubmart.sources.records import typed_panel, typed_works
from pubmart.sources.releases import Release, open_warehouse
from pubmart.verification.raw_roles import raw_panel, raw_works
from pubmart.verification.roles import role_warehouse
from pubmart.verification.selections import MIXED

ALL = FilterState()
FIRST, LAST = 1995, 2001
QUERIES = {
    "yearly_growth": lambda wh: sessions.yearly_growth(wh, FIRST, LAST),
    "monthly_growth": lambda wh: sessions.monthly_growth(wh, FIRST, LAST),
    "country_rank_comparison": lambda wh: sessions.country_rank_comparison(wh, FIRST, LAST),
    "normalised_leadership": lambda wh: sessions.normalised_leadership(wh, FIRST, LAST),
    "income_level_gap": lambda wh: sessions.income_level_gap(wh, FIRST, LAST),
    "topic_annual_leaders": lambda wh: sessions.topic_annual_leaders(wh, FIRST, LAST),
    "wealth_and_intensity": lambda wh: sessions.wealth_and_intensity(wh, FIRST, LAST),
    "overview_metrics": lambda wh: D.overview_metrics(wh, ALL),
    "overview_metrics_filtered": lambda wh: D.overview_metrics(wh, MIXED.state),
    "country_output_fractional": lambda wh: D.country_output(wh, ALL, FRACTIONAL),
    "institution_output_full": lambda wh: D.institution_output(wh, ALL, FULL),
    "subfield_roll_up_full": lambda wh: hierarchy_output(wh, ALL, FULL, "topic", "Subfield"),
    "subfield_evolution_fractional": lambda wh: D.topic_evolution(wh, ALL, FRACTIONAL),
    "source_output": lambda wh: D.source_output(wh, ALL),
    "citation_ranking_topic": lambda wh: D.citation_ranking(wh, ALL, "Topic", FRACTIONAL),
    "citation_distribution": lambda wh: D.citation_distribution(wh, ALL),
    "leadership_ranks": lambda wh: D.leadership_ranks(wh, ALL),
    "country_group_capacity": lambda wh: D.country_group_capacity(wh, ALL),
    "filter_options": D.filter_options,
    "topic_shares": lambda wh: V.topic_shares(wh, ALL, FULL),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="pubmart-bench-")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> object:
        start = time.perf_counter()
        result = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def execute(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    def build_star() -> None:
        release = Release(spark, f"{root}/warehouse")
        for name, rows in role_warehouse(spark, sf_dir).tables().items():
            keyed = name == "fact_publication" or name.startswith("bridge_")
            release.stage(name, rows, ("publication_key",) if keyed else ())
        release.publish()

    timed("build_star", build_star)
    warehouse = open_warehouse(spark, f"{root}/warehouse")
    execute(D.publications_by_year(warehouse, ALL))
    for name, query in QUERIES.items():
        timed(name, lambda query=query: execute(query(warehouse)))

    raw_works(spark, sf_dir).repartition(int(cpus)).write.text(f"{root}/works")
    raw_panel(spark, sf_dir).write.text(f"{root}/panel")
    raw = Release(spark, f"{root}/raw")
    works = timed("parse_works", lambda: raw.stage("works", typed_works(spark.read.text(f"{root}/works"))))

    def reconcile_works() -> None:
        panel = raw.stage("panel", typed_panel(spark.read.text(f"{root}/panel")))
        for name, rows in reconcile(works, panel, place_policy(spark)).items():
            raw.stage(name, rows)

    timed("reconcile_works", reconcile_works)

    def draw_sample() -> None:
        corpus = works.where(S.in_corpus(range(FIRST, LAST + 1)))
        execute(S.sample_ids(corpus, S.allocate(S.population_by_year(corpus), 1000)))

    timed("draw_sample", draw_sample)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
