"""Project settings as ``KEY=VALUE`` text."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass


@dataclass
class Config:
    # The keys and defaults of project files.
    PROJECT: str = ""
    ONT_READ_LIST: str = ""
    GENOME_SIZE: int = 0
    THREADS: int = 4
    MIN_READ_LENGTH: int = 3000
    PREP_OUTPUT_COVERAGE: int = 40
    CNS_OUTPUT_COVERAGE: int = 30
    NUM_ITER: int = 2
    CLEANUP: int = 1
    SMALL_MEMORY: int = 0
    POLISH_CONTIGS: bool = True

    @classmethod
    def parse(cls, text: str) -> Config:
        """Lines of KEY=VALUE; blank lines and ``#`` comments don't count; unknown keys and bad values fail."""
        own = cls()
        for line in text.splitlines():
            line = line.split("#", 1)[0].strip()
            if not line:
                continue
            key, eq, value = (x.strip() for x in line.partition("="))
            if not eq or not hasattr(own, key):
                raise ValueError(f"unknown setting: {line}")
            kind = type(getattr(cls, key))
            setattr(own, key, value.lower() in ("1", "true", "yes") if kind is bool else kind(value))
        return own

    def check(self) -> None:
        for key in ("PROJECT", "ONT_READ_LIST"):
            if not getattr(self, key):
                raise ValueError(f"{key} is not set")
        if self.GENOME_SIZE <= 0 or not 1 <= self.NUM_ITER <= 8:
            raise ValueError("GENOME_SIZE must be above 0, and NUM_ITER from 1 to 8")

    def text(self) -> str:
        return "".join(f"{k}={str(v).lower() if isinstance(v, bool) else v}\n" for k, v in asdict(self).items())

    def digest(self) -> str:
        """What a stage's outputs are valid for: any changed setting makes new ones."""
        return hashlib.sha256(self.text().encode()).hexdigest()[:16]
