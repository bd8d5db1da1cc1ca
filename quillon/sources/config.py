"""Settings of a run, from the environment, and paths that depend on them."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class RunConfig:
    dataset_json: str | None = None
    image_root: str | None = None
    max_samples: int | None = None
    seed: int = 42
    stratify_by: tuple[str, ...] = ()
    q_chains: int = 3
    q_per_chain: int = 3
    answer_max_sources: int = 5
    disable_relevancy: bool = False
    disable_visual: bool = False
    disable_questions: bool = False
    disable_answers: bool = False
    disable_judge: bool = False
    checkpoint_every: int = 100
    provider: str = "openai"
    model: str | None = None
    temperature: float = 0.0
    base_url: str | None = None
    logprobs: bool = False
    followups_per_chain: int = 3
    search_provider: str = "brave"
    search_interval: float = 0.0
    search_jitter: float = 0.0
    requests_per_minute: int | None = None
    daily_quota: int | None = None
    workers: int = 1

    @classmethod
    def from_env(cls, environ=os.environ, prefix: str = "QUILLON_") -> RunConfig:
        """Fields from variables of the upper-case names behind ``prefix``."""
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            if (text := environ.get(prefix + name.upper())) is None:
                continue
            kind = str(field.type)
            if kind == "bool":
                found[name] = text.strip().lower() in ("1", "true", "yes", "on")
            elif kind.startswith("int"):
                found[name] = int(text)
            elif kind.startswith("float"):
                found[name] = float(text)
            elif kind.startswith("tuple"):
                found[name] = tuple(x.strip() for x in text.split(",") if x.strip())
            else:
                found[name] = text
        return cls(**found)

    @property
    def modules(self) -> dict[str, bool]:
        """Which stages run; answers need questions."""
        questions = not self.disable_questions
        return {"relevancy": not self.disable_relevancy, "visual_veracity": not self.disable_visual, "questions": questions, "question_answering": questions and not self.disable_answers, "judge": not self.disable_judge}

    def fingerprint(self) -> str:
        """SHA-256 of the settings as canonical JSON; the sample count may grow between runs and is left out."""
        fields = {k: v for k, v in asdict(self).items() if k != "max_samples"}
        return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), default=list).encode()).hexdigest()


def dataset_path(root: str, override: str | None = None) -> str:
    """The dataset's JSON file: the override, else below ``root`` in ``source``, then beside it, then the first found; on the cluster's file system."""
    if override:
        return override
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for candidate in (f"{root}/source/{folder.getName()}.json", f"{root}/{folder.getName()}.json"):
        if fs.exists(hadoop.Path(candidate)):
            return candidate
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root).select("path").orderBy("path").first() if fs.exists(folder) else None
    if files is None:
        raise FileNotFoundError(f"no dataset JSON below {root}")
    return files[0]
