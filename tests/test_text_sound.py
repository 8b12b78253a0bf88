"""Sound that is made of texts stays within its task, one sound at a time."""

import numpy as np

from textloom.operators import spectral
from textloom.plans import catalog


def test_no_samples_leave_the_task(spark, sf):
    found = catalog.queries()["sg5_sg6_sg7_text_sound"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "array<float>" not in plan
    got = {r.doc_id: r for r in found.collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(12).collect()
    for r in rows:
        x = (np.frombuffer((r.text or "").encode(), np.uint8).astype(np.float32) - 128) / 256
        cleaned, how = spectral.cleaned(x) if len(x) else (None, {})
        changed, steps = spectral.augmented(x, r.doc_id)
        want = (len(x), how.get("noise_frames"), how.get("reduced"), None if cleaned is None else len(cleaned), len(changed), len(steps))
        assert tuple(got[r.doc_id][c] for c in ("n", "noise_frames", "reduced", "n_cleaned", "n_changed", "steps")) == want
