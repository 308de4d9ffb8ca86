"""Settings of the categorization pipeline."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    k: int = 2
    classifier_precision: float = 1.0
    folds: int = 10
    random_per_fold: int = 10
    classify_repetitions: int = 1
    dictionary_location: str | None = None
    strip_extension: bool = True

    def __post_init__(self) -> None:
        if not self.classifier_precision >= 0:
            object.__setattr__(self, "classifier_precision", 0.8)
        object.__setattr__(self, "classify_repetitions", max(1, self.classify_repetitions))
        if self.k < 1 or self.folds < 1 or self.random_per_fold < 1:
            raise ValueError("k, folds and random_per_fold must be at least 1")

    @classmethod
    def from_properties(cls, text: str) -> Settings:
        """Settings from ``key=value`` lines; of dotted keys the last part counts, camelCase or snake_case.
        Unknown keys are ignored; a precision that is no number is 0.8."""
        known, found = {f.name.replace("_", ""): f for f in fields(cls)}, {}
        for line in text.splitlines():
            key, sign, value = line.strip().partition("=")
            f = known.get(key.strip().rpartition(".")[2].replace("_", "").lower())
            if not sign or line.lstrip().startswith(("#", "!")) or f is None:
                continue
            value = value.strip()
            if f.name == "classifier_precision":
                try:
                    found[f.name] = float(value)
                except ValueError:
                    found[f.name] = 0.8
            elif f.name == "strip_extension":
                found[f.name] = value.lower() == "true"
            elif f.name == "dictionary_location":
                found[f.name] = value or None
            else:
                found[f.name] = int(value)
        return replace(cls(), **found)
