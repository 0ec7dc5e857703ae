"""The queue of the streaming operators: lost, late and repeated acquisitions."""

import random

import pandas as pd

from wearline.streaming.online import _InOrder


def drain(queue, numbers):
    return list(queue.release([pd.DataFrame({"sequence_index": numbers, "v": [float(n) for n in numbers]})], "v"))


def test_any_order_comes_out_in_order():
    numbers = list(range(200)) * 2
    random.Random(1).shuffle(numbers)
    queue = _InOrder(0, {}, limit=500)
    out = [x for start in range(0, 400, 37) for x in drain(queue, numbers[start : start + 37])]
    assert out == [(n, float(n)) for n in range(200)] and queue.state() == (200, [], [])


def test_a_lost_acquisition_is_given_up_and_the_state_stays_bounded():
    queue = _InOrder(0, {}, limit=10)
    out = drain(queue, [0, 1, 3, 4])
    assert [n for n, _ in out] == [0, 1] and len(queue.waiting) == 2
    out = drain(queue, list(range(5, 13)))
    assert out == [] and len(queue.waiting) == 10
    assert [n for n, _ in drain(queue, [13])] == list(range(3, 14)) and queue.waiting == {}
    assert drain(queue, [2]) == []  # too late
