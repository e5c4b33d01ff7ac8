"""The panel extended by a month; random Fourier features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from panelwright.operators import kernel
from panelwright.operators.panel import build_panel
from panelwright.plans import extension_queries as eq
from panelwright.plans import month_extension as ext
from panelwright.plans import standins as st


def test_extended_as_built_at_once(spark, tables, tmp_path, monkeypatch):
    """Two extensions, the second killed before its end and called again, give all columns of the panel that is built at once."""
    folder, parts, people = str(tmp_path), eq.panel_rollups(tables), st.entities(tables).where("address_id < 60")
    ext.start(folder, parts, "2000-01-01", "2000-10-01", people)
    assert ext.extend(folder, parts, people) == "2000-11-01"

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ext.once, "put_if_absent", dies)
        with pytest.raises(KeyboardInterrupt):
            ext.extend(folder, parts, people)
    assert ext.months_done(spark, folder) == ["2000-10-01", "2000-11-01"]
    assert ext.extend(folder, parts, people) == "2000-12-01"
    whole = build_panel(people, "2000-01-01", "2000-12-01", **{n: r.rows("2000-01-01", "2000-12-01") for n, r in parts.items()})
    got = ext.stored_panel(spark, folder).where("month_start < '2000-12-01'").select(*whole.columns)
    assert rows(got) == rows(whole) and got.count() > 400
    open_labels = ext.stored_panel(spark, folder).where("month_start = '2000-12-01' and internal_opens_any_next_month is not null")
    assert open_labels.count() == 0


def test_an_extension_reads_the_new_events_only(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for rollup in eq.panel_rollups(tables).values():
        text = rollup.rows("2000-11-01", "2000-11-01")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThanOrEqual(o_orderdate,2000-11-01" in text and "LessThan(o_orderdate,2000-12-01" in text
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_fourier_features_come_close(spark):
    x = np.random.default_rng(3).random((30, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 0.5**2))
    errors = []
    for count in (32, 512, 4096):
        z = np.array([r.z for r in df.select("id", kernel.fourier_row("x", 4, count, 0.5).alias("z")).orderBy("id").collect()])
        w, b = kernel.fourier_weights(4, count, 0.5)
        assert np.allclose(z, np.sqrt(2 / count) * np.cos(x @ w.T + b))
        errors.append(np.abs(z @ z.T - exact).max())
        assert errors[-1] <= kernel.fourier_bound(count, exact.size)
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.1
    other = df.select(kernel.fourier_row("x", 4, 8, 0.5, seed=1).alias("z")).first().z
    assert other != df.select(kernel.fourier_row("x", 4, 8, 0.5, seed=2).alias("z")).first().z


def test_fourier_classifier_separates_a_ring(spark):
    df = spark.range(400).select(F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn(
        "y", (((F.col("a") - 0.5) ** 2 + (F.col("b") - 0.5) ** 2) < 0.09).cast("int")).checkpoint()
    out = kernel.fit_fourier_classifier(df, ["a", "b"], "y", count=60, sigma=0.3).score(df, ["y"])
    assert out.where("(score > 0.5) = (y = 1)").count() > 360
