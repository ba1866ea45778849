import os
import re
import threading
import time

import numpy as np

from estante.llm import neardup
from estante.runtime import ensure_checkpoint_dir


def held(folders):
    total = 0
    for folder in folders:
        for at, _, names in os.walk(folder):
            for name in names:
                try:
                    total += os.path.getsize(os.path.join(at, name))
                except OSError:  # deleted meanwhile
                    pass
    return total


def texts(n):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in ("mar", "tor", "vel", "cas", "pon") for b in ("a", "ei", "o", "u", "ina") for c in ("do", "ra", "lho", "nte", "s", "vel", "gem", "")]
    phrases = [" ".join(rng.choice(words, 6)) for _ in range(600)]
    rows = []
    for i in range(n):
        if i % 9 == 8:
            rows.append((f"c{i:05d}", rows[-1][1], rows[-1][2] + " outra vez"))
        else:
            rows.append((f"c{i:05d}", str(rng.choice(words)), " ".join(x for p in rng.choice(phrases, 18) for x in (p, str(rng.integers(10_000))))))
    return rows


def test_disk_stays_within_four_times_the_table(spark, tmp_path):
    """Checkpoints and shuffle files together, at their peak."""
    spark.createDataFrame(texts(6000), "chunk_id string, entity_name string, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    size = held([tmp_path / "t"])
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), re.sub(r"^file:/*", "/", ensure_checkpoint_dir(spark))]
    before, peak, over = held(folders), [0], threading.Event()

    def watch():
        while not over.is_set():
            peak[0] = max(peak[0], held(folders))
            time.sleep(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = neardup.near_duplicate_pairs(spark.read.parquet(str(tmp_path / "t"))).count()
    finally:
        over.set()
        watcher.join()
    assert found >= 600 and peak[0] - before <= 4 * size, (found, (peak[0] - before) / size)


def test_rounds_and_parts_change_no_pair(spark, monkeypatch):
    rows = texts(400) + [("copy", None, "um dois três quatro"), ("copy2", "", "um dois três quatro")]
    df = spark.createDataFrame(rows, "chunk_id string, entity_name string, text string").repartition(3)
    once = sorted(map(tuple, neardup.near_duplicate_pairs(df).collect()))
    monkeypatch.setattr(neardup, "LEAST", 0)
    monkeypatch.setattr(neardup, "ROUND", 0.2)
    monkeypatch.setattr(neardup, "MOST_ROUNDS", 5)
    monkeypatch.setattr(neardup, "ENTRIES", 500)
    assert neardup.rounds_and_ranges(20_000, 400, 50_000, 4)[0] > 1
    assert sorted(map(tuple, neardup.near_duplicate_pairs(df).collect())) == once and ("copy", "copy2") in once and len(once) >= 44


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(2**62, n, replace=False) - 2**61) for n in (1, 2, 5, 30, 61, 62, 100, 300)]
    counts = [rng.choice([1, 2, 300, 9000], len(g)) for g in sets]
    sig, rec = neardup.all_signatures(np.concatenate(sets), np.array([len(g) for g in sets]), np.concatenate(counts), 0.6)
    for i, (g, c) in enumerate(zip(sets, counts)):
        assert sorted(sig[rec == i].tolist()) == sorted(neardup.signatures(g, c, 0.6).tolist())


def test_members_of_a_run_meet_whatever_the_portion(monkeypatch):
    who = np.array([7, 1, 2, 3, 9, 8, 4, 5])
    starts, held_ = np.array([1, 4, 6]), np.array([3, 2, 2])
    for portion in (1, 2, 1000):
        monkeypatch.setattr(neardup, "PORTION", portion)
        got = sorted((int(a), int(b)) for x, y in neardup._met(starts, held_, who) for a, b in zip(x, y))
        assert got == [(1, 2), (1, 3), (2, 3), (4, 5), (9, 8)]
