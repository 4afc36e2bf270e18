import weakref

import pyarrow as pa

from merscope.llm import batches


class Held:
    pass


def test_memory_is_given_back_when_the_step_has_let_go_of_it(monkeypatch):
    refs, alive = [], []
    monkeypatch.setattr(batches, "give_back", lambda: alive.extend(ref() is not None for ref in refs))

    @batches.frees_memory
    def step(rows):
        held = Held()
        refs.append(weakref.ref(held))
        yield from rows

    assert len(list(step(iter([pa.record_batch({"x": [1]})])))) == 1
    assert alive == [False]


def test_giving_back_is_harmless():
    batches.give_back()
