import pytest
from helpers import by_uid

from pathloom.operators import privacy as p

GOLDEN = [
    (p.LocationAttack(2), [3, 2, 3, 3, 4, 4, 2]), (p.LocationAttack(3), [2, 1, 2, 3, 3, 4, 1]),
    (p.LocationSequenceAttack(2), [2, 2, 1, 2, 1, 3, 2]), (p.LocationSequenceAttack(3), [1, 1, 1, 1, 1, 3, 1]),
    (p.LocationTimeAttack(2, "Hour"), [1, 1, 1, 1, 1, 2, 1]), (p.LocationTimeAttack(2, "Month"), [3, 2, 3, 3, 4, 4, 2]), (p.LocationTimeAttack(3, "Month"), [2, 1, 2, 3, 3, 4, 1]),
    (p.UniqueLocationAttack(2), [3, 4, 3, 3, 4, 4, 4]), (p.UniqueLocationAttack(3), [2, 3, 2, 3, 3, 4, 4]),
    (p.LocationFrequencyAttack(2), [3, 1, 3, 3, 3, 3, 1]), (p.LocationFrequencyAttack(2, 0.5), [3, 1, 3, 3, 4, 4, 1]), (p.LocationFrequencyAttack(3, 0.5), [2, 1, 2, 3, 3, 4, 1]),
    (p.LocationProbabilityAttack(2), [2, 1, 2, 1, 1, 1, 1]), (p.LocationProbabilityAttack(2, 0.5), [3, 2, 3, 3, 4, 1, 1]), (p.LocationProbabilityAttack(3, 0.5), [2, 1, 2, 3, 3, 1, 1]),
    (p.LocationProportionAttack(2), [3, 1, 3, 3, 3, 3, 1]), (p.LocationProportionAttack(2, 0.5), [3, 4, 3, 3, 3, 3, 4]), (p.LocationProportionAttack(3, 0.5), [2, 3, 2, 3, 3, 3, 4]),
    (p.HomeWorkAttack(), [4, 4, 4, 4, 1, 1, 1]),
]


@pytest.mark.parametrize("attack,ones_over", GOLDEN, ids=lambda a: f"{type(a).__name__}{getattr(a, 'knowledge_length', '')}{getattr(a, 'tolerance', '')}" if isinstance(a, p.Attack) else "")
def test_golden(twenty_three, attack, ones_over):
    assert by_uid(attack.assess_risk(twenty_three), "risk") == pytest.approx([1 / n for n in ones_over])


def test_targets_and_instances(twenty_three):
    out = p.LocationAttack(2).assess_risk(twenty_three, targets=[1, 2])
    assert {r.uid for r in out.collect()} == {1, 2}
    told = p.LocationAttack(2).assess_risk(twenty_three, targets=[1], force_instances=True)
    assert told.count() == 12 and set(told.columns) == {"lat", "lng", "uid", "instance", "instance_elem", "prob"}


def test_hot_individual(spark):
    """Instances are as many as the distinct elements make, however often one individual was seen."""
    rows = [(1, 45.0, 9.0 + (i * i) % 3, i) for i in range(20_000)] + [(2, 45.0, 10.0, 5), (2, 45.0, 9.0, 6), (3, 45.0, 9.0, 7)]
    df = spark.createDataFrame(rows, "uid long, lat double, lng double, s long").selectExpr("uid", "lat", "lng", "timestamp_seconds(s) as datetime")
    for attack, ones_over in ((p.LocationAttack(2), [1, 2, 3]), (p.LocationSequenceAttack(2), [1, 2, 3]), (p.LocationTimeAttack(2, "Day"), [1, 2, 3])):
        assert attack._instances(df, copies=False).count() < 20
        assert by_uid(attack.assess_risk(df), "risk") == pytest.approx([1 / n for n in ones_over])


def test_arguments():
    with pytest.raises(ValueError):
        p.LocationAttack(0)
    with pytest.raises(ValueError):
        p.LocationTimeAttack(2, "Century")
    with pytest.raises(ValueError):
        p.LocationFrequencyAttack(2, 1.5)


def test_empty(twenty_three):
    assert p.LocationAttack(2).assess_risk(twenty_three.where("uid = 99")).count() == 0
