import json

import pytest

from strideframe.errors import SettingsError
from strideframe.settings import FIELDS, Settings, read_settings


def test_seeds_follow_unless_they_are_named():
    s = Settings({"seed": 123})
    assert (s["seed"], s["sampling.seed"], s["forest.seed"], s["split.seed"]) == (123, 123, 123, 123)
    s = Settings().overridden({"sampling.seed": 7, "forest": {"seed": 11}}, seed=9)
    assert (s["seed"], s["sampling.seed"], s["forest.seed"], s["split.seed"]) == (9, 7, 11, 9)
    again = s.overridden(seed=5)
    assert (again["seed"], again["sampling.seed"], again["split.seed"]) == (5, 7, 5)


def test_defaults_and_identity():
    s = Settings()
    assert list(s) == list(FIELDS) and len(s) == len(FIELDS) and s["windows.samples"] == 160 and s["split.held_out"] is None
    assert s.identity == Settings({"windows": {"samples": 160}}).identity != Settings({"windows.samples": 80}).identity
    with pytest.raises(TypeError):
        s.values["seed"] = 1


@pytest.mark.parametrize(
    "bad",
    [
        {"sead": 1}, {"windows": {"lenght": 3}}, {"windows": 3}, {"seed": "1"}, {"seed": True}, {"seed": -1}, {"seed": None}, {"seed": 1.0}, {"windows.samples": 0}, {"windows": {"samples": 20}},
        {"split.validation_fraction": 1}, {"split.validation_fraction": "0.1"}, {"scenarios.names": []}, {"scenarios.names": ["other"]}, {"scenarios.names": "trtr"}, {"forest.exact": 1}, {"recordings.variant": "five"},
    ],
)
def test_refusals(bad):
    with pytest.raises(SettingsError):
        Settings(bad)


def test_all_that_is_wrong_is_named_at_once():
    with pytest.raises(SettingsError, match="forest.trees is str.*seed is -3.*wheels isn't a setting"):
        Settings({"seed": -3, "wheels": 4, "forest": {"trees": "many"}})


def test_files(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"windows": {"samples": 80, "hop": 20}, "split.held_out": "harth:S006", "recordings": {"rate_hz": 50}}), "utf-8-sig")
    s = read_settings(spark, str(path), {"windows.hop": 10}, seed=3)
    assert (s["windows.samples"], s["windows.hop"], s["forest.seed"], s["split.held_out"], s["recordings.rate_hz"]) == (80, 10, 3, "harth:S006", 50)
    for text in ("{", "[]", '{"seed": 1, "seed": 2}', ""):
        path.write_text(text)
        with pytest.raises(SettingsError):
            read_settings(spark, str(path))
