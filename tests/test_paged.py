import json
from datetime import date

import pytest

from lodestone.sources import paged

SCHEMA = "court string, case_number string, filing_date date, case_type string, county string, summary string"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Three courts, one without a name; one holds most rows, many of one date, some without a date."""
    path = str(tmp_path_factory.mktemp("pages") / "p")
    rows = [("big/one: ü", f"b{k}", None if k < 25 else date(2024, 1 + k // 40, 1), "CF", f"c{k % 3}", None) for k in range(300)]
    rows += [("small", f"s{k}", date(2024, 2, 1 + k), None, "c1", "x\ny") for k in range(7)] + [(None, "n", date(2024, 3, 1), "CF", "c0", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    paged.land(df, path, "court", ["filing_date", "case_number"], page_size=10)
    df.createOrReplaceTempView("landed_cases")
    return path


def test_pages_are_full_ordered_and_without_gaps(landed):
    s = paged.LandedPages(landed, "court")
    assert set(s.groups()) == {"big/one: ü", "small", None} and len(s.groups()) == 3
    assert s.pages("big/one: ü") == 30 and s.pages("small") == 1 and s.pages(None) == 1
    got = [r for k in range(30) for r in s.page("big/one: ü", k)]
    assert all(len(s.page("big/one: ü", k)) == 10 for k in range(30))
    keys = [(r.get("filing_date") or "", r["case_number"]) for r in got]
    assert keys == sorted(keys) and len(set(keys)) == 300


@pytest.mark.parametrize("where", [
    "true", "court = 'small'", "court in ('small', 'big/one: ü')", "court is null", "filing_date = date '2024-03-01'", "filing_date > date '2024-03-01'", "filing_date >= date '2024-03-01' and filing_date < date '2024-06-01'",
    "filing_date <= date '2024-02-03'", "filing_date is null", "filing_date > date '2030-01-01'", "county = 'c1' and summary like '%y'", "county in ('c0', 'c2') or case_type is null", "court = 'none'", "not county = 'c1'", "filing_date < date '2024-04-01' and filing_date > date '2024-05-01'",
])
@pytest.mark.parametrize("ordered", [True, False])
def test_filters_give_the_landed_rows(spark, landed, where, ordered):
    reader = spark.read.format(paged.register(spark)).option("pagesPerPartition", 4)
    rows = (reader.option("orderedBy", "filing_date") if ordered else reader).load(landed).where(where).drop("error")
    want = spark.table("landed_cases").where(where)
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))


def test_filters_reach_the_source_and_cut_pages(spark, landed):
    rows = spark.read.format(paged.register(spark)).load(landed).where("court = 'small' and county = 'c1' and length(summary) > 1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    condition = next(line for line in plan.splitlines() if "Filter" in line and "BatchScan" not in line)
    assert "length(summary" in condition and "small" not in condition and "c1" not in condition  # what is left to Spark
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains
    from pyspark.sql.types import _parse_datatype_string

    source = paged.PagedRecords({"path": landed, "orderedBy": "filing_date", "pagesPerPartition": "1"})
    reader = source.reader(_parse_datatype_string(paged.CASES))
    left = list(reader.pushFilters([EqualTo(("court",), "big/one: ü"), GreaterThanOrEqual(("filing_date",), date(2024, 5, 1)), LessThan(("filing_date",), date(2024, 6, 1)), StringContains(("summary",), "x")]))
    assert left == [StringContains(("summary",), "x")]
    parts = reader.partitions()  # 40 of 300 rows have that date
    assert {p.group for p in parts} == {"big/one: ü"} and 4 <= len(parts) <= 6
    assert len([r for p in parts for r in reader.read(p)]) == 40


def test_failed_groups_are_rows_and_leave_the_others(spark, landed):
    class Flaky(paged.PagedRecords):
        """`small` never answers; the page counts of the court without a name cannot be had; other pages fail once."""

        @classmethod
        def name(cls):
            return "flaky"

        def service(self):
            class Service(paged.LandedPages):
                failed = False

                def pages(self, group):
                    if group is None:
                        raise OSError("no count")
                    return super().pages(group)

                def page(self, group, number):
                    if group == "small" or not self.failed:
                        self.failed = True
                        raise OSError("no page")
                    return super().page(group, number)

            return Service(self.options["path"], "court")

    name = paged.register(spark, Flaky)
    rows = spark.read.format(name).options(failures="skip", pause="0", tries="2").load(landed)
    read, failed = paged.answered(rows)
    assert {r.court for r in read.select("court").distinct().collect()} == {"big/one: ü"} and read.count() == 300
    assert {(r.court, r.error) for r in failed.collect()} == {("small", "OSError: no page"), (None, "OSError: no count")}
    with pytest.raises(Exception, match="no count|no page"):
        spark.read.format(name).options(pause="0", tries="2").load(landed).collect()
    with pytest.raises(Exception, match="error"):
        spark.read.format(name).schema("court string").options(failures="skip").load(landed).collect()


def test_stream_reads_new_pages_only_and_again_after_a_restart(spark, tmp_path):
    path, out, cp = (str(tmp_path / x) for x in ("p", "out", "cp"))
    name, seen = paged.register(spark), []
    for turn in range(3):
        if turn < 2:
            new = spark.createDataFrame([(c, f"{turn}-{c}-{k}", None, None, None, None) for c in ("a", "b")[: turn + 1] for k in range(25)], SCHEMA)
            paged.land(new, path, "court", ["case_number"], page_size=10)
        stream = spark.readStream.format(name).option("pagesPerPartition", 2).load(path)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        seen.append(spark.read.parquet(out).count())
    assert seen == [25, 75, 75]
    assert spark.read.parquet(out).select("case_number").distinct().count() == 75


def test_other_schemas_and_no_pages(spark, tmp_path):
    folder = tmp_path / "p" / "kind=x" / "page=0"
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text("\n".join(json.dumps(r) for r in ({"n": 3, "at": "2024-05-06T07:08:09Z"}, {"n": None, "at": "never", "more": 1}, {})))
    rows = spark.read.format(paged.register(spark)).schema("kind string, n long, at date").option("by", "kind").load(str(tmp_path / "p"))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([("x", 3, date(2024, 5, 6)), ("x", None, None), ("x", None, None)], key=str)
    (tmp_path / "empty").mkdir()
    assert spark.read.format("paged_records").load(str(tmp_path / "empty")).count() == 0


def test_many_ranges_are_read_by_few_tasks(landed, monkeypatch):
    from pyspark.sql.types import _parse_datatype_string

    class Down(paged.LandedPages):
        def page(self, group, number):
            if number in (4, 17):
                raise OSError(f"page {number}")
            return super().page(group, number)

    class Source(paged.PagedRecords):
        def service(self):
            return Down(self.options["path"], "court")

    got = []
    for most in (2_000, 4):
        monkeypatch.setattr(paged, "TASKS", most)
        reader = Source({"path": landed, "pagesPerPartition": "2", "failures": "skip", "pause": "0"}).reader(_parse_datatype_string(paged.CASES))
        parts = reader.partitions()
        got.append((len(parts), sorted((r for p in parts for r in reader.read(p)), key=str)))
    assert got[0][0] == 17 and got[1][0] <= 6 and got[0][1] == got[1][1]
    assert [r[-1] for r in got[1][1] if r[-1]] == ["OSError: page 17", "OSError: page 4"]
