"""Identity of scenario documents: what it ignores, keeps and rejects."""

import copy
import json

import pytest

from orbweave.operators import identity


def _document():
    sensors = [{"sensor_id": "a", "rate": 1.5}, {"sensor_id": "b", "rate": 2.5}]
    windows = [{"start_time": f"2025-01-01T00:0{i}:00", "end_time": f"2025-01-01T00:0{i}:30", "orbit_number": 1, "agile_data": {"roll_angles": [1.0, 2.0, 3.0]}} for i in range(3)]
    return {
        "scenario_id": "one", "scenario_type": "x", "metadata": {"creation_time": "2025-01-01", "duration": 3600.0, "time_step": 5, "name": "n", "description": "d"},
        "satellites": [{"id": "s1", "sensors": sensors}, {"id": "s2", "sensors": sensors[:1]}], "missions": [{"id": "m1", "priority": 3}, {"id": "m2", "priority": 4}],
        "observation_windows": [{"satellite_id": s, "sensor_id": "a", "mission_id": m, "time_windows": windows} for s in ("s1", "s2") for m in ("m1", "m2")],
    }


def _turned(d):
    for name in ("satellites", "missions", "observation_windows"):
        d[name].reverse()
    for g in d["observation_windows"]:
        g["time_windows"] = g["time_windows"][::-1]
    return json.loads(json.dumps(dict(reversed(list(d.items())))))


def _edit(path, value):
    d = _document()
    at = d
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return d


def test_identity_of_documents(spark, tmp_path):
    alike = {"base": _document(), "turned": _turned(_document()), "named": _edit(["metadata", "name"], "other"), "id": _edit(["scenario_id"], "two")}
    other = {
        "angle": _edit(["observation_windows", 2, "time_windows", 1, "agile_data", "roll_angles", 2], 3.5), "angles": _edit(["observation_windows", 0, "time_windows", 0, "agile_data", "roll_angles"], [2.0, 1.0, 3.0]),
        "sensors": _edit(["satellites", 0, "sensors"], _document()["satellites"][0]["sensors"][::-1]), "priority": _edit(["missions", 1, "priority"], 5), "step": _edit(["metadata", "time_step"], 6), "type": _edit(["scenario_type"], None),
        "fewer": _edit(["satellites"], _document()["satellites"][:1]), "none": _edit(["observation_windows"], []),
    }
    moved = _document()
    moved["observation_windows"][0]["time_windows"] = moved["observation_windows"][0]["time_windows"][:2]
    other["moved"] = moved
    twice = _edit(["missions"], _document()["missions"] + [{"id": "m1", "priority": 9}])
    window = copy.deepcopy(_document())
    window["observation_windows"][1]["time_windows"].append({**window["observation_windows"][1]["time_windows"][0], "agile_data": None})
    bad = {"twice": twice, "window": window, "nokey": _edit(["satellites"], [{"sensors": []}]), "nometa": _edit(["metadata"], {"duration": 1, "time_step": 1})}
    for name, d in (alike | other | bad).items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=1 if name == "turned" else None))
    (tmp_path / "broken.json").write_text('{"scenario_id": ')
    rows = {r.file.split("/")[-1].removesuffix(".json"): r for r in identity.scenario_identity(identity.read_documents(spark, str(tmp_path)), strict=False).collect()}
    assert len({rows[n].digest for n in alike}) == 1 and rows["base"].digest and not any(rows[n].faults for n in alike | other)
    assert len({rows[n].digest for n in ["base", *other]}) == len(other) + 1
    assert {n: rows[n].faults for n in [*bad, "broken"]} == {
        "twice": ["duplicate in missions"], "window": ["duplicate in time_windows"], "nokey": ["missing key in satellites"], "nometa": ["missing key in metadata.creation_time"], "broken": ["unreadable"],
    }
    assert all(rows[n].digest is None for n in [*bad, "broken"])
    docs = identity.read_documents(spark, str(tmp_path))
    with pytest.raises(Exception, match="duplicate in missions"):
        identity.scenario_identity(docs.where("file LIKE '%twice.json'")).collect()
    assert identity.scenario_identity(docs.where("file LIKE '%base.json'")).first().digest == rows["base"].digest
    assert identity.scenario_identity(docs.limit(0)).count() == 0
