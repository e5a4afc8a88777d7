"""JSON lists read from byte ranges: against Python's parser, in ranges of every size."""

import json
import random

import pytest

from hiregrain.sources import files as S
from hiregrain.sources import json_list as J


def value(rng, depth=0):
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choice('ab"\\{}[],: é\n/u') for _ in range(rng.randrange(12)))
    if kind < 0.6 or depth > 2:
        return rng.choice([3, None, True, -1.5])
    if kind < 0.8:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randrange(3))}


def written(rng, path):
    records = [{f'k{i}"\\': value(rng) for i in range(rng.randrange(4))} for _ in range(rng.randrange(7))]
    top = records
    if rng.random() < 0.5:
        before, after = {"meta": [{"a": 1}, value(rng)], "x": value(rng)}, {"more": [{"b": 1}], "o": {"jobs": [{"c": 1}]}}
        top = {**(before if rng.random() < 0.5 else {}), "jobs": records, **(after if rng.random() < 0.5 else {})}
    text = json.dumps(top, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
    path.write_bytes((J.MARK if rng.random() < 0.2 else b"") + rng.choice([b"", b" \n"]) + text.encode() + rng.choice([b"", b"\n"]))
    return records


def asked(_, ranges, key):
    """The first passes, without Spark."""
    told = {}
    for r in ranges:
        source = J.Bytes(r.path)
        made = J.edges(source, r, key) if r.level else {"sums": J.sums(source.read(r.start, r.end), source.escaped(r.start)), "level": J._level(source)}
        told[r.path, r.start] = json.loads(json.dumps(made))
    return told


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_ranges_of_any_size(tmp_path, monkeypatch, size):
    monkeypatch.setattr(J, "_asked", asked)
    rng = random.Random(size)
    for case in range(120):
        path = tmp_path / f"{case}.json"
        want = written(rng, path)
        assert [json.loads(r) for r in J._whole(str(path), "jobs", size)] == want
        got = []
        for part in J.plan_ranges(None, [str(path)], "jobs", size):
            assert part.number == len(got)
            got += [json.loads(r) for r in J.records_of(J.Bytes(str(path)), part, "jobs")]
        assert got == want


@pytest.mark.parametrize("text", ["", "x", "[1]", "[{}", "[{}]]", "[{}] x", '{"a": []}', '{"jobs": {}}', "[{},1]", "[null]", '["a"]', '[{"a": "b]'])
@pytest.mark.parametrize("size", [2, 100])
def test_anything_else_is_an_error(tmp_path, monkeypatch, text, size):
    monkeypatch.setattr(J, "_asked", asked)
    path = tmp_path / "p.json"
    path.write_text(text)
    with pytest.raises(ValueError):
        list(J._whole(str(path), "jobs", size))
    with pytest.raises(ValueError):
        [r for p in J.plan_ranges(None, [str(path)], "jobs", size) for r in J.records_of(J.Bytes(str(path)), p, "jobs")]


def test_one_large_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    jobs = [{"title": f"t{i}", "description": 'x"\\{[' * rng.randrange(40), "n": [{"a": i}]} for i in range(20_000)]
    for name, top in (("list", jobs), ("wrapped", {"jobs": jobs})):
        folder = tmp_path / f"{name}.json"
        folder.mkdir()
        (folder / "a.json").write_text(json.dumps(top))
        (folder / "b.json").write_text(json.dumps(jobs[:3]))
        read = J.read_json_list(spark, str(folder), size=100_000)
        assert read.rdd.getNumPartitions() > 20
        got = sorted((r.record_no, json.loads(r.value)) for r in read.collect())
        assert [n for n, _ in got] == list(range(1, 20_004)) and [v for _, v in got] == [*jobs, *jobs[:3]]
        fields = S.read_postings(spark, str(folder)).where("record_no in (1, 20001)").orderBy("record_no").collect()
        assert [r.title for r in fields] == ["t0", "t0"] and fields[0].extra == {"n": '[{"a":0}]'}


def test_files_as_a_stream(spark, tmp_path):
    spark.dataSource.register(J.JsonListSource)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('[{"a": 1}, {"a": 2}]')

    def run():
        stream = spark.readStream.format("json_list").load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    run()
    (folder / "b.json").write_text('{"jobs": [{"a": 3}]}')
    run()
    assert sorted(json.loads(r.value)["a"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
