"""Label packs, profile names, and the resolution of a request to a list of labels."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions.columns import let, trim_space

# The four label packs, in order.
LABEL_PACKS: dict[str, list[str]] = {
    "default": [
        "person", "email", "phone", "address", "credit card", "ssn", "account number", "password",
        "username", "ip address", "date", "location", "organization",
    ],
    "extended": [
        "person", "name", "first name", "last name", "dob", "age", "gender", "email",
        "email address", "phone", "phone number", "ip address", "url", "address", "location",
        "street", "city", "state", "country", "zip", "account number", "bank account",
        "routing number", "credit card", "card number", "cvv", "ssn", "money", "condition",
        "medical", "drug", "medication", "blood type", "passport", "driver license", "username",
        "password", "license plate", "organization", "company",
    ],
    "private_conversation": [
        "conversation", "private conversation", "direct message", "chat message", "im message",
        "slack message", "zoom chat", "meet transcript", "speaker", "listener",
        "confidential discussion", "customer message", "agent message",
    ],
    "log_intelligence": [
        "log entry", "stack trace", "exception", "error message", "debug message", "credential",
        "token", "api key", "secret", "session id", "container id", "hostname", "ip address",
    ],
}

# Accepted names of a profile besides its own.
PROFILE_ALIASES: dict[str, str] = {
    "conversation": "private_conversation",
    "private": "private_conversation",
    "logs": "log_intelligence",
    "log": "log_intelligence",
}

_PROFILE_OF = {name: name for name in LABEL_PACKS} | PROFILE_ALIASES


def label_packs(spark: SparkSession) -> DataFrame:
    """The packs as a dimension table ``(profile, pos, label)``; 79 rows."""
    rows = [
        (profile, pos, label)
        for profile, labels in LABEL_PACKS.items()
        for pos, label in enumerate(labels)
    ]
    return spark.createDataFrame(rows, "profile string, pos int, label string")


def find_profile(name: str) -> str | None:
    return _PROFILE_OF.get(name.strip().lower())


def profile_column(name: Column) -> Column:
    """Profile of a name, ignoring case and surrounding space; NULL if there is none."""
    key = F.lower(trim_space(name))
    names = F.create_map(*[F.lit(part) for pair in _PROFILE_OF.items() for part in pair])
    return F.try_element_at(names, key)


def distinct_labels(labels: Column) -> Column:
    """Distinct ignoring case; the first spelling wins and the order is kept."""
    def first_spellings(spelled: Column, lowered: Column) -> Column:
        return F.transform(
            F.array_distinct(lowered),
            lambda key: F.get(spelled, F.array_position(lowered, key).cast("int") - F.lit(1)),
        )

    return let(
        labels,
        lambda spelled: let(
            F.transform(spelled, F.lower), lambda lowered: first_spellings(spelled, lowered)
        ),
    )


def pack_column(profile: Column) -> Column:
    """The labels of a profile as an array."""
    packs = [part for name, labels in LABEL_PACKS.items() for part in (F.lit(name), F.lit(labels))]
    return F.try_element_at(F.create_map(*packs), profile)


def resolve_labels_column(
    custom: Column,
    profile: Column,
    extended: Column,
    private: Column,
    log: Column,
    default_profile: str = "default",
) -> Column:
    """Labels of each request row.

    A custom list wins over everything, and an empty one is invalid (NULL here). Otherwise the
    profile, or the default if its name is unknown, is followed by the packs that are switched on.
    """
    none = F.array().cast("array<string>")
    packs = F.concat(
        pack_column(F.coalesce(profile_column(profile), F.lit(default_profile))),
        F.when(extended, F.lit(LABEL_PACKS["extended"])).otherwise(none),
        F.when(private, F.lit(LABEL_PACKS["private_conversation"])).otherwise(none),
        F.when(log, F.lit(LABEL_PACKS["log_intelligence"])).otherwise(none),
    )
    named = F.filter(F.transform(custom, trim_space), lambda label: label != "")
    return F.when(custom.isNull(), distinct_labels(packs)).when(
        F.size(named) > 0, distinct_labels(named)
    )


def resolve_labels(
    labels: Sequence[str] | None = None,
    profile: str | None = None,
    extended: bool = False,
    private: bool = False,
    log: bool = False,
    default_profile: str = "default",
    strict: bool = False,
) -> list[str]:
    """Labels of one request, by the same rules as :func:`resolve_labels_column`."""
    if labels is not None:
        selected = [label.strip() for label in labels if label.strip()]
        if not selected:
            raise ValueError("Custom label list is empty")
    else:
        known = find_profile(profile) if profile is not None else default_profile
        if known is None:
            if strict:
                raise ValueError(f"Unknown label profile: {profile!r}")
            warnings.warn(f"Unknown label profile {profile!r}; using {default_profile!r}", stacklevel=2)
            known = default_profile
        selected = list(LABEL_PACKS[known])
        for wanted, name in (
            (extended, "extended"),
            (private, "private_conversation"),
            (log, "log_intelligence"),
        ):
            if wanted:
                selected += LABEL_PACKS[name]
    first_spelling: dict[str, str] = {}
    for label in selected:
        first_spelling.setdefault(label.lower(), label)
    return list(first_spelling.values())


def unsupported_labels(labels: Sequence[str], vocabulary: Sequence[str]) -> list[str]:
    """Requested labels that the scorer can never produce."""
    known = {label.lower() for label in vocabulary}
    return [label for label in labels if label.lower() not in known]


def unsupported_labels_column(labels: Column, vocabulary: Sequence[str]) -> Column:
    """The same for the labels of each request row."""
    known = F.lit([label.lower() for label in vocabulary])
    return F.filter(labels, lambda label: ~F.array_contains(known, F.lower(label)))
