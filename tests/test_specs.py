"""Band specifications in their forms."""

import pytest

from wavelake.functions import specs
from wavelake.operators import signals

TEN = [("delta", 0.5, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 12.0), ("beta", 12.0, 30.0), ("gamma", 30.0, 80.0)]


def test_bands_around_a_peak(tmp_path):
    assert specs.bands("iaf=10") == TEN == signals.alpha_bands(10.0)
    for text in ("10\n", "# a peak\naggregate_iaf_hz=10\nother=3\n"):
        (tmp_path / "iaf_summary.txt").write_text(text)
        assert specs.bands(f"iaf:{tmp_path}") == TEN == specs.bands(f"iaf:{tmp_path}/iaf_summary.txt") == specs.bands(f"iaf:file://{tmp_path}")
    (tmp_path / "iaf_band_spec.txt").write_text("delta:0.5-4,theta:4-7,alpha:8-12,beta:13-30,gamma:30-80\n")
    assert specs.bands(f"iaf:{tmp_path}/") == specs.bands()  # bands go before a peak


def test_bands_of_a_file(tmp_path):
    (tmp_path / "b.txt").write_text("# one a line\nalpha:8-12\nbeta:13-30,gamma:30-40\n")
    assert specs.bands(f"@{tmp_path}/b.txt") == [("alpha", 8.0, 12.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 40.0)]


@pytest.mark.parametrize("spec", ["iaf=", "iaf=x", "iaf=-3", "iaf:", "iaf:/no/such", "@/no/such", "alpha", "a:5-4"])
def test_refused(spec):
    with pytest.raises(ValueError):
        specs.bands(spec)
