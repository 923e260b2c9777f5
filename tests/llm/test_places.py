"""Records that stay in place whatever their content becomes."""

from pyspark.sql import functions as F

from linkatlas.llm import merkle


def test_corruption_moves_no_record(spark, monkeypatch):
    monkeypatch.setattr(merkle, "MOST", 64)
    rows = [(7, "u", f"<p>{i}</p>") for i in range(600)] + [(8, "u", "<b>"), (8, "u", "<b>"), (8, None, None), (None, None, "<i>"), (300, "v", "<a>"), (300, "v", "<c>")]
    archive = merkle.written(spark.createDataFrame(rows, "page_id long, url string, html string"))
    bad = F.col("html").isin("<p>17</p>", "<p>18</p>", "<p>500</p>", "<a>")
    replica = archive.withColumn("html", F.when(bad, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    report = merkle.audit_report(archive, replica).collect()
    assert len(report) == len(rows) and sum(not r.ok for r in report) == 4
    assert len({r.file for r in report if r.page_id == 7}) > 1
    longer = archive.withColumn("html", F.when(bad, F.concat(F.lit("more"), "html")).otherwise(F.col("html")))
    assert merkle.audit_report(archive, longer).where("not ok").count() == 4
    # A lost and an added record in a range of over a thousand: these alone are reported.
    monkeypatch.undo()
    pages = spark.createDataFrame([(7, f"u{i}", f"<p>{i}</p>") for i in range(1300)], "page_id long, url string, html string")
    archive = merkle.written(pages)
    assert archive.select("warc_file").distinct().count() > 1
    lost = archive.where("url not in ('u3', 'u650')")
    report = merkle.audit_report(archive, lost)
    assert report.count() == 1300 and report.where("not ok").count() == 2
    extra = archive.where("url = 'u9'").selectExpr("page_id", "'new' as url", "html", "warc_file", "warc_seq + 5000 as warc_seq", "warc_offset")
    report = merkle.audit_report(archive, archive.unionByName(extra))
    assert report.count() == 1301 and [r.seq >= 5000 for r in report.where("not ok").collect()] == [True]
