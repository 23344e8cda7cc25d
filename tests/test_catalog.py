"""Every registered raster query runs, and equals its SQL where it has one."""

import numpy as np
import pytest

from rasterloom.operators import spectral
from rasterloom.plans import catalog
from rasterloom.sources import virtual as vr


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(name, against_sql):
    against_sql(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_structure_has_all_bands(spark):
    d = "/root/testdata/sf0.001"
    rows = spectral.usable(vr.spectra(spark, d)).select("o", "n").collect()
    o, n = (np.array([r[k] for r in rows], float) for k in (0, 1))
    assert o.shape[1] == 64
    want = np.sqrt(((np.corrcoef(n.T) - np.corrcoef(o.T)) ** 2).sum())
    got = catalog.QUERIES["spectral_structure"](spark, d).first()["frobenius"]
    assert abs(got - want) < 1e-5
