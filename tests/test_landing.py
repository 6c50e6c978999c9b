"""Signals in pieces against the detector over each whole recording."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from pulsegrid import catalog, catalog_landing
from pulsegrid.operators.rhythm import detect_peaks

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_peaks_of_recordings(spark):
    got = sorted((r["study_id"], r["i"]) for r in catalog.queries()["g20_recorded"](spark, SF).collect())
    t = pq.read_table(f"{SF}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pylist()
    whole = {}
    for r in sorted(t, key=lambda r: r["vec_id"]):
        whole.setdefault(r["vec_id"] // catalog_landing.PIECES, []).extend(r["embedding"])
    want = sorted((f"r_{k}", int(i)) for k, x in whole.items() for i in detect_peaks(np.array(x, dtype=np.float32), 250))
    assert got == want and want
