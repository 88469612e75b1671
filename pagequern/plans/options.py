"""Options of an extraction, validated once and captured by value."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ExtractOptions:
    """What a user may set, and the constants of the method.

    ``compat`` keeps two oddities of the original behaviour: the description meta
    element holds a literal placeholder, and attributes with a hyphen, a colon or
    an empty value survive in the article's markup.
    """

    positive_keywords: str | tuple[str, ...] | None = None
    negative_keywords: str | tuple[str, ...] | None = None
    summary_sentences: int = 5
    headers: Mapping[str, str] = field(default_factory=dict)
    min_paragraph: int = 25
    min_image: tuple[int, int] = (580, 250)
    max_ratio: float = 3.0
    min_srcset: int = 600
    title_similarity: float = 50.0
    compat: bool = False
    fetch_images: bool = False  # fetch the heads of images whose elements tell no size, with these headers

    def __post_init__(self):
        if not isinstance(self.summary_sentences, int) or self.summary_sentences < 0:
            raise ValueError("summary_sentences must be a number of at least 0")
        if not isinstance(self.headers, Mapping):
            raise ValueError("headers must be a mapping")
