"""The small logistic regression where plain Newton steps overshoot."""

import numpy as np

from lodestone.llm.linear import Logistic


def test_classes_that_are_almost_apart():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.1, 0.4):
        y = (rng.random(1500) < share).astype(float)
        seen = y * (rng.random(1500) < 0.87)  # a rare, strong signal in several columns
        x = np.stack([seen * rng.integers(1, 9, 1500), seen * 7.4, seen * 2.7, np.zeros(1500), seen * (rng.random(1500) < 0.3)], axis=1)
        m = Logistic(penalty=0.3).fit(x, y)
        p = m.predict(x)
        assert (p[seen > 0] > 0.5).all() and (p[seen == 0] < 0.5).all()


def test_one_class_or_no_rows():
    assert Logistic().fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (Logistic().fit(np.ones((9, 2)), np.ones(9)).predict(np.ones((1, 2))) > 0.9).all()
