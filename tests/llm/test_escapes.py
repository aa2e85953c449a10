import pytest

from .test_copies import BASE, classes


@pytest.mark.parametrize(
    "plain,escaped",
    [
        ('{"a": "École", "b": 1}', '{"a": "\\u00c9cole", "b": 1}'),
        ('{"a": "Sieben", "b": 1}', '{"a": "\\u0053ieben", "b": 1}'),
        ('{"aa": 2, "Ab": 1}', '{"\\u0041b": 1, "aa": 2}'),
    ],
)
def test_escaped_capitals_are_the_same(spark, plain, escaped):
    assert classes(spark, [(*BASE[:2], plain), (*BASE[:2], escaped)])[0] == {0: (0, 2), 1: (0, 2)}
