import pytest

from physics import fibre
from test_calibration import plan
from thermaline.operators import calibration
from thermaline.operators.sections import sections_frame


@pytest.mark.parametrize("double", [False, True])
def test_too_many_given_attenuations_are_refused(spark, monkeypatch, double):
    monkeypatch.setattr(calibration, "MOST_LOCATIONS", 30)
    x, temps, series, sec = plan(nx=20, nt=3)
    meas, probes = fibre(spark, temps, x, series=series)
    alpha = spark.createDataFrame([(i, 1e-4 * i, 0.0) for i in range(31)], "ix int, alpha double, alpha_var double")
    calibrate = calibration.calibrate_double if double else calibration.calibrate_single
    with pytest.raises(ValueError, match="more than 30 given"):
        calibrate(meas, probes, sections_frame(spark, sec), *[1.0] * (4 if double else 2), fix_alpha=alpha)
