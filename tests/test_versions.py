import threading

import pytest

from millrace.sources import versions
from millrace.sources.versions import claim, drop_versions, load_version, publish, save_version, stage


class Cut(Exception):
    pass


def numbers(spark, n):
    return spark.range(n).repartition(2)


def test_versions_and_pinned_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version"):
        load_version(spark, path)
    assert save_version(numbers(spark, 5), path) == 1
    pinned = load_version(spark, path)
    assert save_version(load_version(spark, path).union(numbers(spark, 3)), path) == 2  # it reads itself
    assert (pinned.count(), load_version(spark, path).count(), load_version(spark, path, 1).count()) == (5, 8, 5)
    assert save_version(numbers(spark, 0).selectExpr("id as other"), path) == 3
    assert load_version(spark, path).columns == ["other"] and load_version(spark, path).count() == 0
    with pytest.raises(ValueError, match="no version 9"):
        load_version(spark, path, 9)


@pytest.mark.parametrize("step", ["_path", "stage", "claim", "publish", "rename"])
def test_a_writer_that_is_cut_off_leaves_the_last_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    save_version(numbers(spark, 5), path)
    with monkeypatch.context() as m:
        if step == "rename":  # the manifest is written beside, and not moved
            whole = versions._path
            calls = []

            def some(session, where):
                if f"/{versions._MANIFESTS}/2" in where:
                    raise Cut
                calls.append(where)
                return whole(session, where)

            m.setattr(versions, "_path", some)
        else:
            def cut(*_):
                raise Cut

            m.setattr(versions, step, cut)
        with pytest.raises(Cut):
            save_version(numbers(spark, 7), path)
    assert load_version(spark, path).count() == 5
    assert save_version(numbers(spark, 9), path) >= 2
    assert load_version(spark, path).count() == 9


def test_writers_at_a_time(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    threads = [threading.Thread(target=lambda n=n: made.append((save_version(numbers(spark, n), path), n))) for n in range(1, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in made) == [1, 2, 3, 4, 5]
    assert all(load_version(spark, path, v).count() == n for v, n in made) and load_version(spark, path).count() == max(made)[1]


def test_a_slow_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    name, number = stage(numbers(spark, 4), path), claim(spark, path)
    assert save_version(numbers(spark, 6), path) == 2
    publish(spark, path, name, numbers(spark, 4).schema, number)
    assert load_version(spark, path).count() == 6 and load_version(spark, path, 1).count() == 4


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(1, 5):
        save_version(numbers(spark, n), path)
    stage(numbers(spark, 1), path)  # by one that is at work
    drop_versions(spark, path, keep=2)
    assert versions.versions(spark, path) == [3, 4] and len(list((tmp_path / "t" / "data").iterdir())) == 5
    drop_versions(spark, path, keep=1, older_s=0)
    assert load_version(spark, path).count() == 4 and len(list((tmp_path / "t" / "data").iterdir())) == 1
    assert save_version(numbers(spark, 8), path) == 5
    with pytest.raises(ValueError):
        drop_versions(spark, path, keep=0)
