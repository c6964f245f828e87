"""Large part files are converted: how large they are follows from how a table was written."""
import pytest

from quire.operators import quality as Q
from quire.plans import pipeline as P
from quire.sources import csv as CSV
from quire.sources import json as JS


def test_files_over_the_usual_limit_are_converted(spark, tmpdir_path, monkeypatch):
    src = f"{tmpdir_path}/in"
    CSV.write_csv(spark.range(300).selectExpr("id", "concat('row ', id) AS name").coalesce(1), src)
    monkeypatch.setitem(Q.MAX_FILE_MB, "csv", 0.001)
    res = P.convert(spark, src, "json", f"{tmpdir_path}/out")
    assert (res.rows_in, res.rows_out) == (300, 300) and [f["code"] for f in res.findings] == ["FILE_TOO_LARGE"]
    assert JS.read_json(spark, res.output_path).count() == 300
    with pytest.raises(ValueError, match="exceeds maximum allowed size"):
        P.convert(spark, src, "json", f"{tmpdir_path}/out2", max_mb=0.001)
