"""Records of JSON array files: whole, spoiled, and of several splits."""

import json
import random

import pytest

from wiregrid.sources import records


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, folder):
    rows = records.read_records(spark, str(folder)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["place"])):
        out.setdefault(r["name"], []).append(r)
    assert all([r["place"] for r in x] == list(range(len(x))) for x in out.values())
    return {name: [r["raw_json"] for r in x] for name, x in out.items()}


def element(draw, depth=0):
    kind = draw.randint(0, 6 if depth < 3 else 3)
    if kind < 3:
        return "".join(draw.choice('ab}{][,:"\\é\n ') for _ in range(draw.randint(0, 12)))
    if kind == 3:
        return draw.choice([1, -2.5, True, None])
    if kind == 4:
        return [element(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    return {f"k{i}": element(draw, depth + 1) for i in range(draw.randint(0, 3))}


def test_random_files_of_several_splits(spark, tmp_path, small_splits):
    draw, told = random.Random(5), {}
    for i in range(12):
        told[f"f{i}.json"] = [
            {"id": k, "x": element(draw)} for k in range(draw.choice([1, 3, 40]))
        ]
        text = json.dumps(told[f"f{i}.json"], ensure_ascii=i % 2 == 0, indent=2 if i % 3 == 0 else None)
        (tmp_path / f"f{i}.json").write_text(text)
    found = read(spark, tmp_path)
    assert {k: [json.loads(x) for x in v] for k, v in found.items()} == told


GOOD = [{"id": i, "t": f"text {i} }} {{", "n": [{"a": 1}, {"b": [2]}]} for i in range(30)]


@pytest.mark.parametrize(
    "spoiled",
    ['{"id": 7, "t": nope}', '{"id": 7, "t": "open, "n": [1]}', '{"id": 7, "t": open", "n": {"a": 1}}',
     '{"id": 7, "t": "a" "b"}', '{"id" 7}', '{"id": tru, "n": [{"a": 1}, {"b": 2}]}'],
)
def test_a_bad_record_costs_itself(spark, tmp_path, small_splits, spoiled):
    texts = [json.dumps(x) for x in GOOD]
    (tmp_path / "first.json").write_text("[" + ", ".join([spoiled, *texts]) + "]")
    (tmp_path / "inner.json").write_text("[" + ",".join(texts[:9] + [spoiled] + texts[9:]) + "]\n")
    (tmp_path / "last.json").write_text("[\n" + ",\n".join([*texts, spoiled]) + "\n]")
    found = read(spark, tmp_path)
    for name, at in (("first.json", 0), ("inner.json", 9), ("last.json", 30)):
        good = [x for i, x in enumerate(found[name]) if i != at]
        assert [json.loads(x) for x in good] == GOOD
        with pytest.raises(json.JSONDecodeError):
            json.loads(found[name][at])


def test_odd_files(spark, tmp_path):
    texts = {
        "cut.json": '[{"id": 1}, {"id": 2}, {"id": 3, "n": {"a": 1}', "none.json": "[]", "nothing.json": "",
        "text.json": "not json", "one.json": '{"id": 1}', "mixed.json": '[1, "a}", {"id": 2}, null, [3]]',
        "empty.json": "[ {}, {} ]", "comma.json": '[{"id": 1},]',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = read(spark, tmp_path)
    assert [json.loads(x) for x in found["cut.json"][:2]] == [{"id": 1}, {"id": 2}]
    assert len(found["cut.json"]) == 3 and found["cut.json"][2].startswith('{"id": 3')
    assert found["text.json"] == ["not json"] and json.loads(found["one.json"][0]) == {"id": 1}
    assert [json.loads(x) for x in found["empty.json"]] == [{}, {}]
    assert json.loads(found["comma.json"][0]) == {"id": 1} and len(found["comma.json"]) == 1
    assert len(found["mixed.json"]) == 5 and found["mixed.json"][0] == "1"
    assert "none.json" not in found and "nothing.json" not in found


def test_a_long_record_comes_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "RECORD_BYTES", 400)
    long = {"id": 1, "n": [{"k": i} for i in range(300)]}
    (tmp_path / "a.json").write_text(json.dumps([{"id": 0}, long, {"id": 2}]))
    found = read(spark, tmp_path)["a.json"]
    assert json.loads(found[0]) == {"id": 0} and json.loads(found[-1]) == {"id": 2}
    assert len(found) > 5 and max(map(len, found)) < 500
