import random

import pytest

SYL = "an er th on re ti la ou ie sch ed in es le que ment ung keit ar do".split()


class Words:
    def __init__(self, seed):
        self.r = random.Random(seed)

    def word(self):
        return "".join(self.r.choice(SYL) for _ in range(self.r.randint(1, 3)))

    def text(self, n):
        return " ".join(self.word() for _ in range(n))


@pytest.fixture
def words():
    return Words(1)
