"""The example script runs end to end."""

import importlib.util
import os

from tests.conftest import ROOT, SF_SMALL


def test_crop_season_example(spark, capsys):
    path = os.path.join(ROOT, "examples", "crop_season.py")
    spec = importlib.util.spec_from_file_location("crop_season", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    mod.main(SF_SMALL)
    out = capsys.readouterr().out
    assert "outputs under" in out and "lc_label" in out
