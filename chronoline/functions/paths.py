"""Expressions over clip and recording paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: graded stages that make a clip class, by path fragment
STAGE_CLASS = {"Stage_2": 1, "Stage_3": 2, "Stage_4": 3, "Stage_5": 4}


def subject_of(path: Column) -> Column:
    """Subject code (RN and three digits) anywhere in a path, else null."""
    return F.nullif(F.regexp_extract(path, r"(RN\d{3})", 1), F.lit(""))


def subject_from_tokens(name: Column, nth_from_end: int = 4) -> Column:
    """Subject as the n-th underscore token from the end."""
    parts = F.split(name, "_")
    return F.try_element_at(parts, F.lit(-nth_from_end))


def clip_dir(path: Column) -> Column:
    """Clip directory of a file in it, with doubled and trailing slashes removed."""
    flat = F.regexp_replace(F.regexp_replace(path, r"/+", "/"), r"(?<=.)/$", "")
    return F.regexp_replace(flat, r"/(video\.mp4|eeg\.edf|info\.txt)$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def session_of(clip_path: Column) -> Column:
    """``subject/session`` of a clip directory."""
    return F.concat_ws("/", subject_of(clip_path), F.try_element_at(F.split(clip_path, "/"), F.lit(-2)))


def clip_class(clip_path: Column) -> Column:
    """0 for a background clip, the stage's class for an event clip, null for others."""
    name = base_name(clip_path)
    stage = F.regexp_extract(name, r"Stage_[0-9]+", 0)
    pairs = [F.lit(x) for kv in STAGE_CLASS.items() for x in kv]
    graded = F.try_element_at(F.create_map(*pairs), stage)
    return F.when(name.startswith("seizure_"), graded).when(name.rlike(r"^clip_.*_vs_seizure_"), F.lit(0))


def channel_kind(name: Column) -> Column:
    """EEG before ECG before anything else."""
    up = F.upper(name)
    return F.when(up.contains("EEG"), "EEG").when(up.contains("ECG"), "ECG").otherwise("UNKNOWN")


def channel_rank(name: Column) -> Column:
    return F.when(channel_kind(name) == "EEG", 1).when(channel_kind(name) == "ECG", 2).otherwise(3)


def unique_labels(labels: Column, width: int = 16) -> Column:
    """Cut labels to ``width`` characters; clashes get ``_0``, ``_1``... after ``width - 2``.

    A fold over the labels of one file: each new name is checked against the names in
    use, which start as the originals and lose a label once it is renamed.
    """
    def rename(used: Column, label: Column) -> Column:
        cut = F.substring(label, 1, width)
        tries = F.concat(
            F.array(cut),
            F.transform(
                F.sequence(F.lit(0), F.size(used)),
                lambda i: F.concat(F.substring(label, 1, width - 2), F.lit("_"), i.cast("string")),
            ),
        )
        return F.get(F.filter(tries, lambda t: ~F.array_contains(used, t)), F.lit(0))

    start = F.struct(labels.alias("used"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, label: Column) -> Column:
        new = F.when(F.length(label) > width, rename(acc["used"], label)).otherwise(label)
        return F.struct(
            F.concat(F.filter(acc["used"], lambda u: u != label), F.array(new)).alias("used"),
            F.concat(acc["out"], F.array(new)).alias("out"),
        )

    return F.aggregate(labels, start, step)["out"]
