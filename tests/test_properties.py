"""Property tests of the driver-side numeric helpers (no Spark)."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusdelta.functions import stats as S
from corpusdelta.operators import batched_logit as BL


@settings(max_examples=40, deadline=None)
@given(st.floats(-8, 8), st.integers(1, 200))
def test_t_p_bounds_and_symmetry(t, df):
    p = S.t_two_sided_p(t, df)
    assert 0 <= p <= 1 and math.isclose(p, S.t_two_sided_p(-t, df), rel_tol=1e-12)


def test_t_p_large_df_tends_to_normal():
    assert math.isclose(S.t_two_sided_p(1.96, 100000), S.normal_two_sided_p(1.96), abs_tol=1e-4)


def test_poisson_weights_moments_and_determinism():
    ids = np.arange(200000)
    w = BL.poisson1_weights(ids, np.array([0, 1]), seed=42)
    assert abs(w[:, 0].mean() - 1) < 0.01 and abs(w[:, 0].var() - 1) < 0.02
    assert np.array_equal(w, BL.poisson1_weights(ids, np.array([0, 1]), seed=42))
    assert not np.array_equal(w[:, 0], w[:, 1])


def test_chi2_sf_matches_normal_for_one_df():
    for x in (0.5, 2.0, 3.84, 10.0):
        assert math.isclose(S.chi2_sf(x, 1), S.normal_two_sided_p(math.sqrt(x)), rel_tol=1e-7)
