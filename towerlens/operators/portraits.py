"""Portraits: which subscribers belong to which gender or age group."""

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import functions as F

from towerlens.functions import columns as C


@dataclass(frozen=True)
class PortraitScheme:
    """A way to label people.

    ``groups`` lists (portrait id, value, comment), ``unnumbered`` the values without a portrait id.
    """

    groups: tuple
    gender_value: Callable
    age_value: Callable
    min_age: int | None = None
    unnumbered: tuple = ()

    @property
    def values(self):
        return [value for _, value, _ in self.groups] + list(self.unnumbered)

    def lookup(self, position):
        """Map column from a value to its portrait id (0) or comment (2)."""
        pairs = []
        for group in self.groups:
            pairs += [F.lit(group[1]), F.lit(group[position])]
        return F.create_map(*pairs)

    def flag(self, label):
        """One bit per value; 0 for a label outside the scheme."""
        bit = F.lit(0)
        for number, value in enumerate(self.values):
            bit = F.when(label == value, 1 << number).otherwise(bit)
        return bit

    def labels(self, flags):
        """The values whose bits are set."""
        every = F.array(*[F.lit(value) for value in self.values])
        return F.filter(every, lambda value, number: F.getbit(flags, number) == 1)


# Portrait ids, values and comments of the standard portraits.
STANDARD = PortraitScheme(
    groups=(
        (1, "1", "男性"),
        (2, "0", "女性"),
        (3, "10", "10-20岁人员"),
        (4, "20", "20-40岁人员"),
        (5, "40", "40岁以上人员"),
    ),
    gender_value=C.gender_code,
    age_value=C.age_band,
    min_age=10,
)

# The alternative labels. 'none' (gender outside 0/1) has no portrait id.
CLOSED_UPPER = PortraitScheme(
    groups=(
        (1, "boy", "男孩"),
        (2, "girl", "女孩"),
        (3, "age20down", "年龄小于20岁"),
        (4, "age20-40", "年龄20到40岁"),
        (5, "age40up", "年龄40岁以上"),
    ),
    gender_value=C.gender_name,
    age_value=C.age_band_closed_upper,
    unnumbered=("none",),
)


def user_portraits(user_info, user_index, scheme=STANDARD):
    """``(bitmap_id, portrait_values)``: one row per user with all their labels.

    Gender and age labels come from one pass over the users. The labels of a user are bits of one
    number, so they combine in a hash aggregate before the shuffle, and the join with the index
    keeps that partitioning.
    """
    people = user_info
    if scheme.min_age is not None:
        people = people.where(F.col("age") >= scheme.min_age)
    gender, age = scheme.gender_value(F.col("gender")), scheme.age_value(F.col("age"))
    per_user = (
        people.select("imsi", scheme.flag(gender).bitwiseOR(scheme.flag(age)).alias("_flags"))
        .groupBy("imsi")
        .agg(F.bit_or("_flags").alias("_flags"))
    )
    return per_user.join(user_index, "imsi").select(
        "bitmap_id", scheme.labels(F.col("_flags")).alias("portrait_values")
    )


def portrait_members(labelled, scheme=STANDARD, kinds=("gender", "age")):
    """``(portrait_id, portrait_value, comment, bitmap_id)``: membership rows, each once.

    Gender and age labels never coincide, so putting them side by side needs no de-duplication.
    ``kinds`` restricts the result to the gender or the age portraits.
    """
    rows = labelled.select("bitmap_id", F.explode("portrait_values").alias("portrait_value"))
    ids = F.try_element_at(scheme.lookup(0), F.col("portrait_value"))
    if set(kinds) == {"gender"}:
        rows = rows.where(~F.col("portrait_value").isin(_age_values(scheme)))
    elif set(kinds) == {"age"}:
        rows = rows.where(F.col("portrait_value").isin(_age_values(scheme)))
    return rows.select(
        ids.alias("portrait_id"),
        "portrait_value",
        F.try_element_at(scheme.lookup(2), F.col("portrait_value")).alias("comment"),
        "bitmap_id",
    )


def _age_values(scheme):
    return [value for number, value, _ in scheme.groups if number >= 3]


def portrait_sizes(members):
    """Number of users per portrait."""
    return members.groupBy("portrait_id", "portrait_value", "comment").agg(
        F.count("bitmap_id").alias("n_users")
    )
