import json
import random

import pytest

from millrace.sources.files import load_documents
from millrace.sources.jsonarrays import STATES, load_array, objects_of, save_array, summary

ODD = [{"id": 1, "topic": "a", "text": 'quote " and \\ and \\" end'}, {"id": 2, "text": "[{,}] \\\\"}, {"id": 3, "topic": None, "text": "é漢\U0001f600\n"}, {"id": 4, "topic": "\\", "text": ""}, {}, {"id": 6, "more": {"x": [1, {"y": "]}"}]}, "text": "t" * 40}]


def pieces(data, step, read_on=3):
    """All objects by parts of ``step`` bytes, each from the state that the parts before end in."""
    read, out, state = (lambda at, n: data[at : at + n]), [], (False, False, 0)
    for at in range(0, len(data), step):
        out += [json.loads(x) for x in objects_of(read, at, min(step, len(data) - at), len(data), state, read_on)]
        inside, escaped, more = summary(data[at : at + step])[STATES.index(state[:2])]
        state = (inside, escaped, state[2] + more)
    assert state == (False, False, 0)
    return out


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_every_cut(indent, ascii_only):
    data = json.dumps(ODD, indent=indent, ensure_ascii=ascii_only).encode()
    for step in range(1, len(data) + 2):
        assert pieces(data, step) == ODD


def test_generated_arrays():
    rng = random.Random(1)

    def value(depth):
        kind = rng.randint(0, 5 if depth else 2)
        text = "".join(rng.choice('"\\[]{},: aé\n') for _ in range(rng.randint(0, 6)))
        return text if kind < 3 else {text + str(k): value(depth - 1) for k in range(rng.randint(0, 3))} if kind < 5 else [value(depth - 1) for _ in range(rng.randint(0, 3))]

    for _ in range(60):
        rows = [{f"k{j}": value(3) for j in range(rng.randint(0, 3))} for _ in range(rng.randint(0, 5))]
        data = json.dumps(rows).encode()
        for step in (1, 2, 3, 7, 50):
            assert pieces(data, step, rng.randint(1, 9)) == rows


@pytest.mark.parametrize("part", [1, 5, 64, 1 << 20])
def test_one_array_by_many_tasks(spark, tmp_path, part):
    path = tmp_path / "a.json"
    path.write_bytes(b"\xef\xbb\xbf" * (part == 64) + json.dumps(ODD).encode())
    made = load_array(spark, str(path), part_bytes=part)
    plain = load_documents(spark, str(path))
    assert made.schema == plain.schema and sorted(made.collect(), key=str) == sorted(plain.collect(), key=str)


def test_broken_arrays(spark, tmp_path):
    for i, text in enumerate(['[{"id": 1}', '{"id": 1}', '[{"id": 1}, 5]', '[{"id": "x"}]', '[[{"id": 1}]]', '[{"id": 1, "text": "a]', ""]):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            load_array(spark, str(path)).collect()
    (tmp_path / "empty.json").write_text(" [ ] ")
    assert load_array(spark, str(tmp_path / "empty.json")).count() == 0


def test_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else "t", f'x"{i}\\') for i in range(50)], "id bigint, topic string, text string").repartition(4)
    save_array(rows, str(tmp_path / "out"))
    save_array(rows.limit(0).coalesce(1), str(tmp_path / "none"))
    assert sorted(map(tuple, load_array(spark, str(tmp_path / "out"), part_bytes=100).collect())) == sorted(map(tuple, rows.collect()))
    assert load_array(spark, str(tmp_path / "none")).count() == 0
