"""Labels, ground truth and scores of claim records, as column expressions.

All functions take and return columns, so they run inside whole-stage code
generation. Truth and prediction are 1 (misinformation), 0 (not) or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, classes and synonyms as data files hold them.
MISINFORMATION, NOT_MISINFORMATION, UNCERTAIN = "Misinformation", "Not Misinformation", "Uncertain"
FAKE_CLASSES = ("textual_veracity_distortion", "visual_veracity_distortion", "mismatch")
ORIGINAL_CLASS = "original"
ALIGNED_TRUE = ("true", "yes", "aligned", "relevant", "clear")
ALIGNED_PARTIAL = ("partial", "partially", "context", "uncertain")
ALIGNED_FALSE = ("false", "no", "misaligned", "irrelevant", "mismatch")
GENERATED_TRUE = ("true", "yes", "ai", "likely", "manipulated")
GENERATED_FALSE = ("false", "no", "authentic", "genuine")
TRUTH_REAL = ("real", "true", "aligned", "1", "1.0", "yes", "y")
TRUTH_FAKE = ("fake", "false", "misaligned", "0", "0.0", "no", "n")
CLASS_REAL = ("original", "real", "authentic", "genuine")
BOOLEAN_TRUE = ("true", "yes", "y", "1")
BOOLEAN_FALSE = ("false", "no", "n", "0")
TRUTHY = ("1", "true", "yes", "on")


def _clean(value: Column) -> Column:
    return F.lower(F.trim(value))


def _says_not(low: Column) -> Column:
    return low.contains("not") & low.contains("mis")


def metric_prediction(label: Column) -> Column:
    """Prediction for metrics: a leading ``mis`` decides before a negation is looked for."""
    low = _clean(label)
    return F.when(low.startswith("mis"), 1).when(_says_not(low), 0)


def report_prediction(label: Column) -> Column:
    """Prediction for reports: a negation decides first."""
    low = _clean(label)
    return F.when(_says_not(low), 0).when(low.startswith("mis"), 1)


def canonical_label(label: Column) -> Column:
    """One of the three labels; anything unknown is uncertain."""
    pred = report_prediction(label)
    return F.when(pred == 0, NOT_MISINFORMATION).when(pred == 1, MISINFORMATION).otherwise(UNCERTAIN)


def exact_truth(gt: Column) -> Column:
    """1 for exactly ``Fake``, else 0, null included."""
    return F.coalesce((gt == "Fake").cast("int"), F.lit(0))


def tolerant_truth(gt: Column, fake_cls: Column) -> Column:
    """Truth from many spellings of the answer, else from the class."""
    answer, cls = _clean(gt), _clean(fake_cls)
    return (
        F.when(answer.isin(*TRUTH_REAL), 0)
        .when(answer.isin(*TRUTH_FAKE), 1)
        .when(cls.isin(*CLASS_REAL), 0)
        .when(cls != "", 1)
    )


def known_truth(gt: Column, fake_cls: Column) -> Column:
    """Truth from exact spellings; null where the row is to be dropped."""
    return F.when(gt == "Fake", 1).when(gt == "Real", 0).when(fake_cls.isin(*FAKE_CLASSES), 1).when(fake_cls == ORIGINAL_CLASS, 0)


def generated_truth(source: Column) -> Column:
    """Whether an image source says that the image is generated; null without a source."""
    return F.when(source.isNotNull(), (_clean(source) == "ai-generated image").cast("int"))


def class_key(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("unknown"))


def class_bucket(value: Column) -> Column:
    """Class of a VARIANT answer for balancing: text as it is, anything else as JSON with sorted keys."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def penalised(pred: Column, truth: Column) -> Column:
    """A missing prediction counts as the wrong one."""
    return F.coalesce(pred, 1 - truth)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))


def misinformation_score(label: Column, confidence: Column) -> Column:
    """P(misinformation) from a label and its confidence (0.5 where missing)."""
    conf = F.coalesce(confidence.cast("double"), F.lit(0.5))
    return F.when(label == NOT_MISINFORMATION, 1.0 - conf).when(label == MISINFORMATION, conf).otherwise(0.5)


def badge(pred: Column, truth: Column) -> Column:
    return (
        F.when(pred.isNull(), "Uncertain")
        .when(truth.isNull(), "No GT")
        .when(pred != truth, "Incorrect vs GT")
        .otherwise(F.concat(F.lit("Correct: "), F.when(pred == 1, MISINFORMATION).otherwise(NOT_MISINFORMATION)))
    )


def aligned(value: Column) -> Column:
    """``true``, ``partial``, ``false`` or null."""
    low = _clean(value)
    return F.when(low.isin(*ALIGNED_TRUE), "true").when(low.isin(*ALIGNED_PARTIAL), "partial").when(low.isin(*ALIGNED_FALSE), "false")


def generated(value: Column) -> Column:
    low = _clean(value)
    return F.when(low.isin(*GENERATED_TRUE), True).when(low.isin(*GENERATED_FALSE), False)


def boolean(value: Column) -> Column:
    """Boolean of common spellings; null for anything else."""
    low = _clean(value)
    return F.when(low.isin(*BOOLEAN_TRUE), True).when(low.isin(*BOOLEAN_FALSE), False)


def truthy(value: Column) -> Column:
    """An environment flag: null if unset, else whether it is set to a true word."""
    return F.when(value.isNotNull(), _clean(value).isin(*TRUTHY))


def index(value: Column) -> Column:
    """A whole number from text that holds just one; null for booleans, fractions and the rest."""
    text = F.trim(value)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))


def number(value: Column) -> Column:
    return value.try_cast("double")


def positive(value: Column) -> Column:
    parsed = number(value)
    return F.when(parsed > 0, parsed)


def stage_verdict(raw: Column, stage: str) -> Column:
    """struct(verdict, confidence) from the finishing marker of a stage's answer."""
    says = lambda marker: F.coalesce(raw.contains(f"Finish[{marker}]"), F.lit(False))
    # fixed values: markers, verdicts and confidences of the three stages
    if stage == "text":
        verdict = F.when(says("TEXT REFUTES"), "REFUTES").when(says("TEXT SUPPORTS"), "SUPPORTS").otherwise("INSUFFICIENT")
        conf = F.when(verdict == "INSUFFICIENT", 0.5).otherwise(0.8)
    elif stage == "image":
        verdict = F.when(says("IMAGE REFUTES"), "REFUTES").otherwise("SUPPORTS")
        conf = F.when(verdict == "REFUTES", 0.8).otherwise(0.7)
    elif stage == "cross":
        verdict = F.when(says("MATCH"), "CONSISTENT").when(says("MISMATCH"), "MISMATCH").otherwise("PARTIAL")
        conf = F.when(verdict == "PARTIAL", 0.5).otherwise(0.8)
    else:
        raise ValueError(f"unknown stage {stage!r}")
    return F.struct(verdict.alias("verdict"), conf.alias("confidence"))


def cascade(text: Column, image: Column, cross: Column) -> Column:
    """Decision over three stage verdicts: the first objection decides, else the claim is authentic."""
    mean = (text["confidence"] + image["confidence"] + cross["confidence"]) / 3.0
    row = lambda label, cls, conf: F.struct(F.lit(label).alias("label"), F.lit(cls).alias("fake_cls"), conf.alias("confidence"))
    return (
        F.when(text["verdict"] == "REFUTES", row(MISINFORMATION, FAKE_CLASSES[0], text["confidence"]))
        .when(image["verdict"] == "REFUTES", row(MISINFORMATION, FAKE_CLASSES[1], image["confidence"]))
        .when(cross["verdict"] == "MISMATCH", row(MISINFORMATION, FAKE_CLASSES[2], cross["confidence"]))
        .otherwise(row(NOT_MISINFORMATION, ORIGINAL_CLASS, mean))
    )


def heuristic_judgement(aligned_: Column, relevancy: Column, generated_: Column, veracity: Column) -> Column:
    """struct(label, confidence, key_factors) from the two signals alone.

    ``aligned_`` is true/partial/false text, ``generated_`` a boolean; the others
    are their confidences, 0 where missing.
    """
    rel, ver = F.coalesce(number(relevancy), F.lit(0.0)), F.coalesce(number(veracity), F.lit(0.0))
    # fixed values: weights of the signals and thresholds of the labels
    r = F.when(aligned_ == "true", -rel).when(aligned_ == "false", rel).when(aligned_ == "partial", -0.4 * rel).otherwise(0.0)
    v = F.when(generated_, 0.5 * ver).when(~generated_, -0.25 * ver).otherwise(0.0)
    score = 0.7 * r + 0.3 * v
    label = F.when(score >= 0.3, MISINFORMATION).when(score <= -0.3, NOT_MISINFORMATION).otherwise(UNCERTAIN)
    about = lambda words, conf: F.format_string(f"{words} (conf ~%.2f)", conf)
    factors = F.array_compact(
        F.array(
            F.when(aligned_ == "true", about("Relevancy aligned", rel))
            .when(aligned_ == "false", about("Relevancy misaligned", rel))
            .when(aligned_ == "partial", about("Relevancy partial alignment", rel)),
            F.when(generated_, about("Image likely AI/manipulated", ver)).when(~generated_, about("Image likely authentic", ver)),
        )
    )
    confidence = F.round(clamp(0.3 + F.least(F.lit(0.6), F.abs(score))), 2)
    return F.struct(label.alias("label"), confidence.alias("confidence"), factors.alias("key_factors"))
