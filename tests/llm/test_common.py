import os

import pytest

from corpusmill.llm import common


def test_staged_tables_can_be_cleared(spark):
    frame = common.staged(spark.range(5).toDF("x"))
    assert sorted(r.x for r in frame.collect()) == [0, 1, 2, 3, 4]
    folder = os.path.dirname(frame.inputFiles()[0].removeprefix("file://"))
    assert os.path.isdir(folder)
    common.clear_staged(spark)
    assert not os.path.exists(folder)


def test_a_task_gives_back_the_memory_that_it_freed():
    """What a worker's allocator keeps counts against the executor while the next stages run."""
    import re
    from pathlib import Path

    rollup, kept = Path("/proc/self/smaps_rollup"), []
    if not rollup.exists():
        pytest.skip("no figures of memory here")

    def held():
        return int(re.search(r"Pss_Anon:\s+(\d+)", rollup.read_text())[1]) // 1024

    def run(batches):
        for batch in batches:
            blocks = [b"x" * 60_000 for _ in range(4000)]
            kept.append(b"x" * 60_000)  # lies above them
            yield batch
            assert held() > before + 200 and len(blocks) == 4000

    before = held()
    assert list(common.frugal(run)(iter([1]))) == [1]
    assert held() < before + 60


def test_the_tasks_of_the_pipeline_give_memory_back(monkeypatch):
    from corpusmill.llm import langid, packing, simhash

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    for task in (langid._count(8), simhash._features(5), simhash._cell_links(57, 0.8), simhash._unit_links(5, 57, 0.8)):
        given.clear()
        assert not sum(b.num_rows for b in task(iter(()))) and given == [1]
    assert all(hasattr(x, "__wrapped__") for x in (langid._keep(None, 0, 1, 0.0), packing._tokenize("", 64, 2)))
