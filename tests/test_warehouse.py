from __future__ import annotations

import datetime

import pytest
from samples import four_cells, three_works

from pyspark.sql import functions as F

from pubmart.functions import measures as M
from pubmart.operators import checks as C
from pubmart.plans import dashboard as D
from pubmart.plans import derived as V
from pubmart.plans import gates
from pubmart.plans import sessions as S
from pubmart.plans.attribution import FRACTIONAL, FULL, Fractional, _labels_by_leaf, fractional_count, hierarchy_output, totals_by
from pubmart.plans.filters import FilterState, filtered_publications
from pubmart.plans.load import load_reconciled, load_warehouse
from pubmart.schemas import BY_YEAR, MISSING_VALUE, WAREHOUSE
from pubmart.sources.releases import PublishConflict, Release, create_once, current_version, open_table, open_warehouse
from pubmart.verification import layout_cases

ALL = FilterState()


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    import json

    base = tmp_path_factory.mktemp("load")
    for name, records in (("works", three_works()), ("panel", four_cells())):
        (base / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records))
    reconciled = load_reconciled(
        spark, str(base / "works.jsonl"), str(base / "panel.jsonl"), str(base / "reconciled")
    )
    return reconciled, load_warehouse(spark, reconciled, str(base / "warehouse")), str(base / "warehouse")


@pytest.fixture(scope="module")
def wh(loaded):
    return loaded[1]


def rows(frame) -> list[tuple]:
    return [tuple(row) for row in frame.collect()]


def test_counts(wh):
    counts = {name: table.count() for name, table in wh.tables().items()}
    assert counts == {
        "dim_date": 3,
        "dim_country": 5,
        "dim_topic": 2,
        "dim_institution": 4,
        "dim_source": 1,
        "fact_publication": 3,
        "fact_country_year": 4,
        "bridge_publication_topic": 4,
        "bridge_publication_country": 5,
        "bridge_publication_institution": 4,
    }


def test_date_row(wh):
    first = wh.dim_date.orderBy("date_key").first()
    assert tuple(first) == (20220405, datetime.date(2022, 4, 5), 5, 4, 2, 2022)
    key = wh.dim_date.select("full_date", M.date_of(wh.dim_date.date_key).alias("again"))
    assert all(day == again for day, again in rows(key))


def test_weights_and_primary_marker(wh):
    bridge = wh.bridge_publication_topic.join(
        wh.fact_publication.where("work_id like '%W1'"), "publication_key", "left_semi"
    )
    found = rows(bridge.orderBy("topic_rank").select("is_primary_topic", "fractional_weight"))
    assert found == [(False, 0.5), (True, 0.5)]


def test_keys_follow_natural_order_and_are_stable(spark, loaded):
    reconciled, wh, root = loaded
    before = rows(wh.dim_country.orderBy("country_key").select("country_key", "country_code_iso2"))
    assert before == [(1, "DE"), (2, "IT"), (3, "RE"), (4, "TW"), (5, "US")]
    again = load_warehouse(spark, reconciled, root)
    assert current_version(spark, root) == 2
    for name, table in again.tables().items():
        assert sorted(map(str, rows(table))) == sorted(map(str, rows(wh.table(name))))


def test_failed_build_keeps_the_published_version(spark, loaded):
    reconciled, _, root = loaded
    version = current_version(spark, root)
    with pytest.raises(C.CheckFailed, match="year range on fact_country_year: 1"):
        load_warehouse(spark, reconciled, root, first=2023)
    doubled = {**reconciled, "r_work_topic": reconciled["r_work_topic"].unionAll(reconciled["r_work_topic"])}
    with pytest.raises(C.CheckFailed, match="duplicate key on bridge_publication_topic"):
        load_warehouse(spark, doubled, root)
    lacking = {**reconciled, "r_work": reconciled["r_work"].drop("language", "source_id")}
    with pytest.raises(C.CheckFailed, match="r_work: language, source_id"):
        load_warehouse(spark, lacking, root)
    assert current_version(spark, root) == version
    assert open_warehouse(spark, root).fact_publication.count() == 3


def test_smoke_queries(wh):
    assert rows(S.smoke_year_trend(wh)) == [(2022, 2, 14), (2023, 1, 2)]
    assert rows(S.smoke_institution_types(wh)) == [("education", 3)]
    assert rows(S.smoke_source_types(wh)) == [("journal", 2), ("<missing>", 1)]
    assert len(rows(S.smoke_countries(wh))) == 5
    assert [r[3] for r in rows(S.smoke_topics(wh))] == [2, 2]
    assert rows(S.smoke_publication_types(wh)) == [("article", 1), ("preprint", 1), ("review", 1)]


def test_zero_denominators_give_null(wh):
    panel = wh.fact_country_year.withColumns(
        {"population": wh.fact_country_year.population * 0, "gdp_current_usd": wh.fact_country_year.gdp_current_usd * 0}
    )
    found = D.leadership_ranks(wh.replace(fact_country_year=panel), ALL).collect()
    assert found and all(
        row.publications_per_million is None
        and row.publications_per_billion_gdp is None
        and row.per_million_rank is None
        and row.gdp_rank_shift is None
        for row in found
    )
    assert {row.absolute_rank for row in found} >= {1}


def test_roll_up_counts_a_publication_once(wh):
    for method in (FULL, FRACTIONAL):
        result = rows(hierarchy_output(wh, ALL, method, "topic", "Subfield"))
        assert [(name, n) for _, name, n in result] == [("Learning", 3.0)]
    leaves = {name: n for _, name, n in rows(D.topic_output(wh, ALL, FULL))}
    assert leaves == {"Vision": 2.0, "Language": 2.0}


def test_group_capacity_uses_matched_denominators(wh):
    europe = D.country_group_capacity(wh, ALL, "Region").where(
        "member like 'Europe%' and calendar_year = 2023"
    ).first()
    assert europe.population == 143_000_000
    assert europe.publications_per_million == pytest.approx(0.5e6 / 143_000_000)
    assert (europe.full_publications, europe.countries, europe.population_countries) == (1, 2, 2)
    unplaced = D.country_group_capacity(wh, ALL, "Region").where("member = 'Missing / unavailable'")
    assert {(r.calendar_year, r.countries, r.population) for r in unplaced.collect()} == {
        (2022, 2, None),
        (2023, 2, None),
    }


def test_filters(wh):
    def works(state):
        kept = filtered_publications(wh, state).join(wh.fact_publication, "publication_key")
        return {row.work_id[-2:] for row in kept.select("work_id").collect()}

    assert works(FilterState(2023, 2023)) == {"W3"}
    assert works(FilterState(countries=("TW",))) == {"W1"}
    assert works(FilterState(regions=(MISSING_VALUE,))) == {"W1", "W2"}
    # Both conditions have to hold for the same country.
    assert works(FilterState(countries=("IT",), regions=("North America",))) == set()
    assert works(FilterState(source_types=(MISSING_VALUE,))) == {"W2"}
    assert works(FilterState(source_types=("journal",))) == {"W1", "W3"}
    assert works(FilterState(source_types=("journal", MISSING_VALUE))) == {"W1", "W2", "W3"}
    assert works(FilterState(open_access_values=(MISSING_VALUE,))) == {"W3"}
    assert works(FilterState(open_access_values=("false", MISSING_VALUE))) == {"W2", "W3"}
    assert works(FilterState(publication_types=("review",), languages=("en",))) == {"W2"}


def test_filter_on_one_bridge_leaves_other_weights(wh):
    state = FilterState(topics=("https://ids.example/T1",))
    found = {r.country_code_iso2: r.publications for r in D.country_output(wh, state, FRACTIONAL).collect()}
    assert found == {"RE": 1.0, "IT": 0.5, "TW": 0.5}
    shown = {r.country_code_iso2 for r in D.country_output(wh, FilterState(countries=("IT",)), FULL).collect()}
    assert shown == {"IT"}


def test_fractional_totals_add_up_to_represented_publications(wh):
    for output in (D.country_output, D.institution_output):
        assert sum(r.publications for r in output(wh, ALL, FRACTIONAL).collect()) == pytest.approx(3)


def test_overview(wh):
    assert tuple(D.overview_metrics(wh, ALL).first()) == (3, 16, 5, 4, 2, 50.0)
    assert tuple(D.overview_metrics(wh, FilterState(start_year=2030)).first()) == (0, None, 0, 0, 0, None)


def test_time_series(wh):
    months = rows(D.temporal_navigation(wh, ALL, "Month"))
    assert [n for _, n, _ in months] == [1, 0, 0, 0, 0, 0, 1, 0, 0, 1]
    assert months[0] == (datetime.date(2022, 4, 1), 1, None)
    assert months[1][2] == -100 and months[2][2] is None
    assert rows(D.temporal_navigation(wh, FilterState(start_year=2030), "Quarter")) == []
    assert [n for _, n, _ in rows(D.temporal_navigation(wh, ALL, "Year"))] == [2, 1]


def test_total_growth(wh):
    assert rows(V.total_growth(D.publications_by_year(wh, ALL))) == [(2022, 2023, -50.0)]
    growth = V.adjacent_year_growth(D.publications_by_year(wh, ALL))
    assert [r.year_over_year_growth for r in growth.collect()] == [None, -50.0]


@pytest.mark.parametrize(
    "call",
    [
        lambda wh: D.temporal_navigation(wh, ALL, "Week"),
        lambda wh: D.country_output(wh, ALL, "Half"),
        lambda wh: hierarchy_output(wh, ALL, FULL, "source", "Type"),
        lambda wh: hierarchy_output(wh, ALL, FULL, "topic", "Keyword"),
        lambda wh: D.citation_ranking(wh, ALL, "Keyword"),
        lambda wh: D.country_group_capacity(wh, ALL, "Continent"),
        lambda wh: D.institution_evolution(wh, ALL, FULL, ()),
        lambda wh: filtered_publications(wh, FilterState(open_access_values=("maybe",))),
        lambda wh: V.paired_snapshot(wh, ALL, "Weather", 2023),
    ],
)
def test_unknown_choices(wh, call):
    with pytest.raises(ValueError):
        call(wh)


def test_plans_scan_only_what_they_need(wh):
    plan = D.publications_by_year(wh, FilterState(2022, 2022))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(date_key,20220000)" in plan and "LessThan(date_key,20230000)" in plan
    assert "bridge" not in plan and "dim_" not in plan
    executed = D.country_output(wh, FilterState(regions=("North America",)), FULL)
    text = executed._jdf.queryExecution().optimizedPlan().toString()
    # The country bridge is joined once; its own filter needs no second pass over it.
    assert text.count("fractional_weight") <= 4 and "bridge_publication_topic" not in text


def test_year_folders_of_both_sides(spark, loaded, tmp_path):
    """A query over one year opens that year's folders of the fact and of the bridge, with and without buckets."""
    reconciled, wh, _ = loaded
    stored = {
        "plain": load_warehouse(spark, reconciled, str(tmp_path / "plain")),
        "bucketed": load_warehouse(spark, reconciled, str(tmp_path / "bucketed"), buckets=4),
    }
    for kind, warehouse in stored.items():
        for name in BY_YEAR:
            assert warehouse.table(name).columns == list(WAREHOUSE[name])
            folders = warehouse.within(name, 2022, 2022).select("_metadata.file_path").distinct().collect()
            assert folders and all("stored_year=2022/" in r.file_path for r in folders), (kind, name)
            assert warehouse.table(name).count() == wh.table(name).count()
        query = D.country_output(warehouse, FilterState(2022, 2022), FRACTIONAL)
        plan = query._jdf.queryExecution().executedPlan().toString()
        pruned = [line for line in plan.splitlines() if "PartitionFilters: [isnotnull(stored_year" in line]
        assert len(pruned) == 2 and plan.count("FileScan parquet") == 3, kind
        assert rows(query) == rows(D.country_output(wh, FilterState(2022, 2022), FRACTIONAL))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query = D.country_output(stored["bucketed"], FilterState(2022, 2023), FRACTIONAL)
        plan = query._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(publication_key" not in plan and plan.count("Bucketed: true") == 2
        # A later session finds the folders again.
        for table in spark.catalog.listTables():
            spark.sql(f"DROP TABLE IF EXISTS {table.name}")
        again = open_warehouse(spark, str(tmp_path / "bucketed"))
        assert rows(D.publications_by_year(again, FilterState(2023, 2023))) == [(2023, 1, 2, 2.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_undated_publications_have_a_folder(spark, wh, tmp_path):
    from pubmart.plans.build import with_years

    facts = wh.fact_publication.withColumn("date_key", F.when(F.col("publication_key") > 1, F.col("date_key")))
    release = Release(spark, str(tmp_path / "undated"))
    tables = with_years(wh.replace(fact_publication=facts))
    stored = wh.replace(**{name: release.stage(name, tables[name], ("publication_key",)) for name in BY_YEAR})
    assert rows(D.publications_by_year(stored, ALL))[-1][:2] == (None, 1)
    assert rows(D.publications_by_year(stored, FilterState(2000, 2100))) == rows(D.publications_by_year(stored, ALL))[:-1]
    assert sum(r.publications for r in D.country_output(stored, ALL, FRACTIONAL).collect()) == pytest.approx(3)
    assert sum(r.publications for r in D.country_output(stored, FilterState(2000), FRACTIONAL).collect()) == pytest.approx(2)


def test_buckets_save_the_shuffle(spark, loaded, tmp_path):
    reconciled, wh, _ = loaded
    root = str(tmp_path / "bucketed")
    bucketed = load_warehouse(spark, reconciled, root, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = FilterState(topics=("https://ids.example/T1",))

        def shuffles(frame) -> int:
            plan = frame._jdf.queryExecution().executedPlan().toString()
            return plan.count("hashpartitioning(publication_key")

        for query, left in (
            (lambda w: D.country_output(w, ALL, FRACTIONAL), 0),
            # Bridge rows that first meet a dimension too large to broadcast move once.
            (lambda w: D.country_output(w, state, FULL), 1),
            # Rows and leaders are two uses of the same exchange.
            (lambda w: hierarchy_output(w, ALL, FULL, "country", "Region", 30), 2),
        ):
            assert rows(query(bucketed)) == rows(query(wh))
            assert shuffles(query(bucketed)) <= left < shuffles(query(wh))
        # A later session knows the files only.
        for name in spark.catalog.listTables():
            spark.sql(f"DROP TABLE IF EXISTS {name.name}")
        again = open_warehouse(spark, root)
        assert rows(S.smoke_topics(again)) == rows(S.smoke_topics(wh))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_readiness(wh):
    tables = wh.tables()
    assert gates.readiness_problems(tables, (2022, 2023)) == []
    assert gates.readiness_problems(tables) == [
        "fact_country_year lacks years 2018, 2019, 2020, 2021, 2024, 2025"
    ]
    old = {**tables, "dim_year": tables["dim_date"]}
    del old["dim_source"]
    found = gates.readiness_problems(old)
    assert any(p.startswith("dim_source: ") for p in found) and "dim_year is obsolete" in found
    empty = {**tables, "bridge_publication_topic": tables["bridge_publication_topic"].limit(0)}
    assert "bridge_publication_topic is empty" in gates.readiness_problems(empty, (2022,))


def test_exact_totals_do_not_depend_on_order(spark):
    rows = spark.range(2_000_000).selectExpr("id % 2 AS member", "1.0D / (3 + id div 2 % 11) AS fractional_weight", "id")
    found = set()
    for order in ("id", "-id", "hash(id)"):
        placed = rows.repartitionByRange(7, F.expr(order)).sortWithinPartitions(F.expr(order))
        found |= {r.total for r in totals_by(placed, ["member"], total=Fractional(F.lit(1))).collect()}
    assert len(found) == 1  # both members hold equal weights: a tie in every order


def test_thirty_million_thirds_tie_with_ten_million_wholes(spark):
    wholes = spark.range(10_000_000).selectExpr("'whole' AS member", "1.0D AS fractional_weight", "1 AS publication_count")
    thirds = spark.range(30_000_000).selectExpr("'thirds' AS member", "1.0D / 3 AS fractional_weight", "1 AS publication_count")
    mixed = spark.range(40_000_000).selectExpr("'mixed' AS member", "1.0D / if(id % 4 = 0, 2, 6) AS fractional_weight", "1 AS publication_count")
    found = totals_by(wholes.union(thirds).union(mixed), ["member"], full=F.sum("publication_count"), fractional=fractional_count())
    assert {tuple(r) for r in found.collect()} == {("whole", 10_000_000, 1e7), ("thirds", 30_000_000, 1e7), ("mixed", 40_000_000, 1e7)}


def test_fractions_against_exact_rationals(spark):
    import random
    from fractions import Fraction

    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(1, 400), rng.choice([None, 0, 1, 7, 10**12])) for _ in range(3000)] + [(9, 7, None), (8, 10**15, 5)]
    frame = spark.createDataFrame(rows, "member int, n long, cited long").selectExpr("member", "1.0D / n AS fractional_weight", "cited")
    found = {r.member: r for r in totals_by(frame, ["member"], shown=Fractional(F.col("cited")), exact=Fractional(F.col("cited"), shown=False)).collect()}
    assert found[9].shown is None and found[9].exact is None
    for member in (0, 1, 2, 8):
        want = sum((Fraction(c, n) for m, n, c in rows if m == member and c is not None), Fraction(0))
        assert abs(Fraction(found[member].exact) - want) < Fraction(1, 10**15) and found[member].shown == pytest.approx(float(want))


def test_totals_of_fractions_hash_whole_numbers(spark):
    frame = spark.range(10).selectExpr("id % 2 AS member", "1.0D / (1 + id % 3) AS fractional_weight", "id + 1 AS publication_count")
    plan = totals_by(frame, ["member"], n=fractional_count())._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 4
    first = [line for line in plan.splitlines() if "partial_sum" in line][-1]
    assert "decimal" not in first and "partial_sum(publication_count" in first


def test_leaders_of_yearly_thirds_tie_with_wholes(spark, wh):
    """Three publications of a third in three years weigh as much as a whole one: the smaller id leads."""
    topics = spark.createDataFrame(
        [(1, "A", "a", "SA", "sa", "F", "f", "D", "d"), (2, "B", "b", "SB", "sb", "F", "f", "D", "d"), (3, "C", "c", "SC", "sc", "F", "f", "D", "d")],
        "topic_key long, topic_id string, topic_name string, subfield_id string, subfield_name string, field_id string, field_name string, domain_id string, domain_name string",
    )
    facts = spark.createDataFrame(
        [(k, f"W{k}", year * 10000 + 101, None, "article", "en", True, 1, 0) for k, year in ((1, 2018), (2, 2019), (3, 2020), (4, 2020))], wh.fact_publication.schema
    )
    pairs = [(k, t, 1 / 3) for k in (1, 2, 3) for t in (1, 3, 2)] + [(4, 2, 1.0)]
    bridge = spark.createDataFrame([(k, t, 1, 0.5, True, w) for k, t, w in pairs if (k, t) != (9, 9)], "publication_key long, topic_key long, topic_rank int, topic_score double, is_primary_topic boolean, fractional_weight double")
    found = hierarchy_output(wh.replace(dim_topic=topics, fact_publication=facts, bridge_publication_topic=bridge), ALL, FRACTIONAL, "topic", "Subfield", 2, evolution=True)
    totals = {}
    for r in found.collect():
        totals[r.member_id] = totals.get(r.member_id, 0) + r.publications
    assert totals == {"SA": pytest.approx(1), "SB": pytest.approx(2)}


def test_weights_of_many_members(spark):
    def bridge(n: int, extra: float):
        return spark.range(n).selectExpr("7L AS publication_key", f"1.0D / {n} + if(id = 0, {extra}D, 0D) AS fractional_weight")

    assert C.weight_sums(bridge(100_000, 0.0), "b").first().violations == 0
    assert C.weight_sums(bridge(100_000, 1e-5), "b").first().violations == 1
    assert C.weight_sums(bridge(3, 1e-9), "b").first().violations == 1


def test_overview_filters_publications_once(wh):
    """One scan of the fact and of each bridge; members are bits, not distinct pairs."""
    plan = D.overview_metrics(wh, FilterState(2022, 2023))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert sum("publication_count" in line for line in scans) == 1
    assert sum("publication_key" in line for line in scans) == 4
    assert "bitmap_construct_agg" in plan


def test_overview_counts_only_members_of_the_dimensions(spark, wh):
    """Keys of several buckets, and keys without a member."""
    keys = [1, 2, 32_768, 32_769, 70_000, 10**9]
    members = spark.createDataFrame([(k, f"I{k}", "n", "education", None) for k in keys], "institution_key long, institution_id string, institution_name string, institution_type string, country_code_iso2 string")
    pairs = spark.createDataFrame([(1, k, 0.1) for k in keys[1:]] + [(2, k, 0.1) for k in keys[:4]] + [(2, 5, 0.1), (99, 1, 1.0)], "publication_key long, institution_key long, fractional_weight double")
    found = D.overview_metrics(wh.replace(dim_institution=members, bridge_publication_institution=pairs), ALL).first()
    assert (found.publications, found.institutions, found.countries) == (3, 6, 5)
    only = wh.replace(dim_institution=members, bridge_publication_institution=pairs.where("publication_key = 1"))
    assert D.overview_metrics(only, ALL).first().institutions == 5


def test_two_writers(spark, tmp_path):
    """One of two writers that began from the same release wins, the other is told, and readers see one whole version."""
    root = str(tmp_path / "releases")
    first, second = Release(spark, root), Release(spark, root)
    assert first.version != second.version and current_version(spark, root) == 0
    for name in ("a", "b"):
        first.stage(name, spark.range(3))
        second.stage(name, spark.range(5))
    second.publish()
    with pytest.raises(PublishConflict):
        first.publish()
    seen = lambda: {name: open_table(spark, root, name).count() for name in ("a", "b")}
    assert seen() == {"a": 5, "b": 5} and current_version(spark, root) == 1
    first.publish(retries=1)
    assert seen() == {"a": 3, "b": 3} and current_version(spark, root) == 2
    # a log file that is still being written does not count; the number is taken
    late = Release(spark, root)
    assert create_once(spark, f"{root}/_releases/{3:020d}.json", "")
    assert seen() == {"a": 3, "b": 3} and not create_once(spark, f"{root}/_releases/{3:020d}.json", "x")
    late.stage("a", spark.range(7))
    with pytest.raises(PublishConflict):
        late.publish()


def test_many_writers_claim_different_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "claims")
    with ThreadPoolExecutor(4) as pool:
        releases = list(pool.map(lambda _: Release(spark, root), range(4)))
    assert sorted(r.version for r in releases) == [1, 2, 3, 4]


def test_releases_logged_without_a_sequence_are_read(spark, tmp_path):
    root = str(tmp_path / "old")
    for version in (1, 2):
        spark.range(version).write.parquet(f"{root}/version={version}/a")
        row = spark.createDataFrame([(version, ["a"], None)], "version BIGINT, tables ARRAY<STRING>, buckets BIGINT")
        row.coalesce(1).write.mode("append").json(f"{root}/_releases")
    assert current_version(spark, root) == 2 and open_table(spark, root, "a").count() == 2
    release = Release(spark, root)
    release.stage("a", spark.range(9))
    assert release.version == 3
    release.publish()
    assert current_version(spark, root) == 3 and open_table(spark, root, "a").count() == 9


def test_catalogue_reads_each_dimension_once(wh):
    plan = D.filter_options(wh)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    for column in ("topic_name", "country_name", "institution_type"):
        assert sum(column in line for line in scans) == 1, column
    labels = [(r.filter_name, r.label) for r in D.filter_options(wh).collect()]
    assert labels.index(("open_access", "Open Access")) + 1 == labels.index(("open_access", "Not Open Access"))
    regions = [label for name, label in labels if name == "region"]
    assert regions[-1] == "Missing / unavailable" and regions[:-1] == sorted(regions[:-1])


def test_fused_key_checks_against_single_ones(spark):
    """Seeded faults: doubled keys, lost references, NULLs on both sides, a parent without children."""
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "k long")
    parent, one, two = frame([1, 2, 2, 3, None, None]), frame([1, 1, 4, 4, 4, None]), frame([5, 2])
    found = {(r.check, r.relation): r.violations for r in C.key_checks(parent, "k", [(one, "k", "one"), (two, "k", "two")], "parent").collect()}
    single = [C.duplicate_keys(parent, "parent", ("k",)), C.orphans(one, "k", parent, "k", "one"), C.orphans(two, "k", parent, "k", "two")]
    assert found == {(r.check, r.relation): r.violations for r in C.all_checks(single).collect()}
    assert found == {("duplicate key", "parent"): 2, ("orphan", "one.k"): 3, ("orphan", "two.k"): 1}
    none = {r.violations for r in C.key_checks(frame([]), "k", [(frame([]), "k", "one")], "parent").collect()}
    assert none == {0}


def test_key_checks_read_each_table_once(wh):
    from pubmart.schemas import WAREHOUSE_KEYS, WAREHOUSE_REFERENCES

    checks = C.all_checks(C.table_checks(wh.tables(), WAREHOUSE_KEYS, WAREHOUSE_REFERENCES))
    plan = checks._jdf.queryExecution().executedPlan().toString()
    wanted = {(child, column) for child, column, *_ in WAREHOUSE_REFERENCES} | {(parent, key) for *_, parent, key in WAREHOUSE_REFERENCES}
    wanted |= {(name, key[0]) if len(key) == 1 else (name, key) for name, key in WAREHOUSE_KEYS.items()}
    assert plan.count("FileScan parquet") <= len(wanted)
    assert {r.violations for r in checks.collect()} == {0}


@pytest.mark.parametrize("buckets", [None, 2])
def test_a_bridge_without_rows_is_stored_and_read(spark, loaded, tmp_path, buckets):
    reconciled, _, _ = loaded
    none = {**reconciled, "r_work_institution": reconciled["r_work_institution"].limit(0), "r_institution": reconciled["r_institution"].limit(0)}
    root = str(tmp_path / "none")
    load_warehouse(spark, none, root, buckets=buckets)
    for table in spark.catalog.listTables():
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    again = open_warehouse(spark, root)
    assert again.table("bridge_publication_institution").count() == 0 and again.fact_publication.count() == 3
    assert rows(D.institution_output(again, FilterState(2022, 2023), FRACTIONAL)) == []
    assert D.overview_metrics(again, ALL).first().institutions == 0


def test_full_counts_of_a_level_make_pairs_distinct_by_numbers(wh):
    plan = hierarchy_output(wh, ALL, FULL, "topic", "Subfield")._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if "Aggregate [publication_key" in line]
    assert pairs and not any("name" in line or "member_id" in line for line in pairs)


def test_labels_by_leaf_keep_unnamed_members_and_repeated_leaves_apart(spark):
    labels = spark.createDataFrame(
        [(3, "a", "a", None), (1, "a", "a", "a"), (2, "a", "a", None), (2, "a", "a", None), (2, "b", "b", "b"), (None, "c", "c", "c")],
        "topic_key LONG, member_id STRING, member_name STRING, raw_name STRING",
    )
    members, leaves = _labels_by_leaf(labels, "topic_key")
    assert sorted(rows(members.select("member_id", "raw_name", "_label")), key=str) == [("a", "a", 1), ("a", None, 2), ("b", "b", 2)]
    assert sorted(rows(leaves)) == [(1, 1), (2, 2), (3, 2)]


def test_buckets_follow_the_largest_table(spark):
    tables = [spark.range(25), spark.range(101)]
    assert layout_cases.buckets_for(tables, 4, each=10) == 11
    assert layout_cases.buckets_for(tables, 4, each=50) == 4
    assert layout_cases.buckets_for([spark.range(0)], 4, each=10) == 4


def test_tables_are_stored_in_more_buckets_than_asked_for_when_they_are_large(spark, tmp_path, monkeypatch):
    orders = spark.range(1, 41).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "9000D AS o_totalprice",
        "timestamp'1997-03-04 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 81).selectExpr("id % 40 + 1 AS l_orderkey", "id AS l_partkey", "id % 3 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    others = {
        "nation": "id AS n_nationkey, id AS n_regionkey, 'N' AS n_name",
        "region": "id AS r_regionkey, 'R' AS r_name",
        "supplier": "id AS s_suppkey, 'S' AS s_name, id AS s_nationkey",
        "customer": "id AS c_custkey, 'C' AS c_name, 'M' AS c_mktsegment, id AS c_nationkey",
        "part": "id AS p_partkey, 'P' AS p_name, 'B1' AS p_brand, 'T' AS p_type",
    }
    for name, columns in others.items():
        spark.range(3).selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    asked = []
    monkeypatch.setattr(layout_cases.buckets_for, "__defaults__", (10,))
    monkeypatch.setattr(layout_cases, "Release", lambda spark, root, buckets: asked.append(buckets) or Release(spark, root, buckets))
    stored = layout_cases.stored_by_year(spark, str(tmp_path), "topic", buckets=4)
    assert asked == [8] and stored.bridge_publication_topic.count() == 80
    layout_cases.stored_by_year(spark, str(tmp_path), "topic")
    assert asked == [8, None]
