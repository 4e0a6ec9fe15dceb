"""The rule dimension: one row a rule, with the sets that the severity policy joins to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RANK = {"info": 0, "warn": 1, "error": 2}

#: rule: (advisory, relaxed in tests, kept in relaxed paths, what it reports)
RULES: dict[str, tuple[bool, bool, bool, str]] = {
    "as-any": (True, False, False, "a cast that turns type checks off"),
    "bare-except": (False, False, False, "a handler without an exception type"),
    "brittle-exact-string": (True, False, False, "a test pinned to a long literal"),
    "conditional-assert": (True, False, False, "a test that asserts on some paths only"),
    "contract-case-skew": (False, False, False, "a schema field in another spelling"),
    "contract-drift-key": (False, True, False, "a key that its schema does not have"),
    "dead-code": (False, False, True, "statements after a return, raise, break or continue"),
    "debug-artifact": (False, False, False, "output left from debugging"),
    "deep-nesting": (False, True, False, "blocks within blocks beyond the limit"),
    "diverged-duplicate": (True, False, False, "a function that is nearly a copy of another"),
    "duplicate-code": (True, False, False, "a block of lines that occurs elsewhere"),
    "duplicate-function": (False, False, False, "a function of the same shape as another"),
    "excessive-mocking": (True, False, False, "a test of six or more mocks"),
    "hand-rolled-contract": (False, True, False, "a dict that spells out a message of a schema"),
    "hedging-comment": (True, False, False, "a comment that puts the work off"),
    "long-comment": (True, False, False, "a comment block beyond the limit"),
    "long-function": (False, True, False, "a function beyond the limit of lines"),
    "mock-echo-test": (True, False, False, "a test of the value its mock was given"),
    "mock-only-test": (False, False, False, "a test that asserts on mocks only"),
    "mutable-default": (False, False, False, "a default value that calls share"),
    "no-assert-test": (True, False, False, "a test without an assertion"),
    "overspecified-assert": (True, False, False, "a test pinned to a large literal"),
    "parametrize-candidate": (False, False, False, "tests that differ in literals only"),
    "placeholder-body": (True, False, False, "a function that does nothing"),
    "private-poke-test": (True, False, False, "a test that reads private state"),
    "redundant-comment": (True, False, False, "a comment that repeats the code"),
    "single-method-class": (False, False, False, "a class around one method"),
    "sleep-in-test": (False, False, False, "a test that waits for real"),
    "swallowed-exception": (False, False, False, "an exception dropped without a word"),
    "syntax-error": (False, False, True, "a file that does not parse"),
    "tautological-assert": (False, False, False, "an assertion that cannot fail"),
    "ts-ignore": (True, False, False, "a type error told to be quiet"),
    "type-ignore": (False, False, False, "a type comment that hides an error"),
    "unused-import": (True, False, False, "an import without a use"),
    "unused-private": (True, False, False, "a private name without a use"),
    "write-only-attr": (True, False, False, "an attribute that is set and never read"),
}


def rule_dimension(spark: SparkSession) -> DataFrame:
    """rule, advisory, test_relaxed, path_blocking, about: 36 rows, fit to broadcast."""
    return spark.createDataFrame([(r, *v) for r, v in sorted(RULES.items())], "rule string, advisory boolean, test_relaxed boolean, path_blocking boolean, about string")
