"""What the driver's process keeps once an operator is through."""

import weakref

from rallyline.llm import linear, quality


def test_training_gives_the_examples_memory_back(spark, monkeypatch):
    held, alive = [], []
    fit = linear.follow_leader

    def follow(examples, settings):
        held.extend(weakref.ref(value) for _, _, value in examples)
        return fit(examples, settings)

    monkeypatch.setattr(linear, "follow_leader", follow)
    monkeypatch.setattr(linear, "give_back", lambda: alive.append(sum(r() is not None for r in held)), raising=False)
    rows = spark.createDataFrame([(i, f"word{i} and more of it", i % 2) for i in range(20)], "doc_id long, text string, label int")
    linear.train(rows, quality.features, quality.SETTINGS)
    assert len(held) == 20 and alive == [0]
