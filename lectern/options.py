"""Options with their defaults and ranges; out of range raises ValueError on the driver.

Names, defaults and ranges are fixed values.
"""

from __future__ import annotations

from contextvars import ContextVar
from dataclasses import asdict, dataclass, field

STRATEGIES = ("paragraph", "balanced", "greedy", "simple")


#: Where the ranges and choices of a class are noted while limits() makes one.
_NOTED: ContextVar[dict | None] = ContextVar("noted", default=None)


def limits(cls: type) -> dict[str, dict]:
    """By field: low, high and null of a range, or choices; as the class checks them."""
    token = _NOTED.set({})
    try:
        cls()
        return _NOTED.get()
    finally:
        _NOTED.reset(token)


def _note(name: str, **limit) -> None:
    if (noted := _NOTED.get()) is not None:
        noted[name] = limit


def _one_of(name: str, value, choices: tuple, called: str) -> None:
    _note(name, choices=choices)
    if value not in choices:
        raise ValueError(f"unknown {called} {value!r}")


def _within(name: str, value, low, high=None, null: bool = False) -> None:
    _note(name, low=low, high=high, null=null)
    if value is None and null:
        return
    if value is None or value < low or (high is not None and value > high):
        raise ValueError(f"{name} is {value!r}, outside {low} to {'any' if high is None else high}")


@dataclass(frozen=True)
class TextOptions:
    """Normalisation and chunking; None switches a repetition limit off."""

    text_language: str = "en"
    to_lowercase: bool = False
    remove_bracketed_text: bool = False
    normalize_scene_breaks: bool = True
    min_scene_break_length: int = 3
    normalize_repeated_punctuation: bool = True
    normalize_emphasis: bool = True
    normalize_stuttering: bool = True
    max_repeated_alpha_chars: int | None = 4
    max_repeated_symbol_chars: int | None = 1
    chunking_strategy: str = "paragraph"
    shortness_penalty_factor: float = 2.0
    ideal_chunk_length: int = 300
    max_chunk_length: int = 500

    def __post_init__(self) -> None:
        _one_of("chunking_strategy", self.chunking_strategy, STRATEGIES, "chunking strategy")
        _within("min_scene_break_length", self.min_scene_break_length, 2)
        _within("max_repeated_alpha_chars", self.max_repeated_alpha_chars, 1, null=True)
        _within("max_repeated_symbol_chars", self.max_repeated_symbol_chars, 1, null=True)
        _within("shortness_penalty_factor", self.shortness_penalty_factor, 1)
        _within("ideal_chunk_length", self.ideal_chunk_length, 50, 1000)
        _within("max_chunk_length", self.max_chunk_length, 50, 1000)


@dataclass(frozen=True)
class ValidationOptions:
    """Limits of the quality checks; None switches a check off."""

    max_silence_dbfs: float | None = -60.0
    max_contiguous_silence_s: float | None = 2.8
    min_voiced_duration_per_syllable: float | None = 0.150
    max_voiced_duration_per_syllable: float | None = 0.350
    min_syllables_for_duration_validation: int | None = 7
    use_word_level_duration_analysis: bool = True
    min_word_len_for_low_complexity_analysis: int = 7
    low_complexity_log_variety_threshold: float = 1.6
    low_complexity_chars_per_syllable: float = 4.0
    low_complexity_max_duration_per_syllable: float = 0.6
    max_clipping_percentage: float | None = 0.1
    min_spectral_centroid_std_dev: float | None = 1800.0
    min_syllables_for_spectral_validation: int | None = 7

    def __post_init__(self) -> None:
        _within("max_silence_dbfs", self.max_silence_dbfs, -120, -10, null=True)
        _within("max_contiguous_silence_s", self.max_contiguous_silence_s, 0, 10, null=True)
        _within("min_voiced_duration_per_syllable", self.min_voiced_duration_per_syllable, 0, 2, null=True)
        _within("max_voiced_duration_per_syllable", self.max_voiced_duration_per_syllable, 0, 5, null=True)
        _within("min_syllables_for_duration_validation", self.min_syllables_for_duration_validation, 1, null=True)
        _within("low_complexity_log_variety_threshold", self.low_complexity_log_variety_threshold, 0, 5)
        _within("low_complexity_chars_per_syllable", self.low_complexity_chars_per_syllable, 1, 10)
        _within("low_complexity_max_duration_per_syllable", self.low_complexity_max_duration_per_syllable, 0, 10)
        _within("min_spectral_centroid_std_dev", self.min_spectral_centroid_std_dev, 0, 6000, null=True)
        _within("min_syllables_for_spectral_validation", self.min_syllables_for_spectral_validation, 1, null=True)
        _within("min_word_len_for_low_complexity_analysis", self.min_word_len_for_low_complexity_analysis, 3, 20)
        _within("max_clipping_percentage", self.max_clipping_percentage, 0, 100, null=True)


@dataclass(frozen=True)
class AlignmentOptions:
    """Word-score checks. Severity maps give, from a word length on, the score below which a word counts."""

    critical: dict = field(default_factory=lambda: {1: 0.15, 4: 0.20})
    poor: dict = field(default_factory=lambda: {1: 0.25, 2: 0.35, 4: 0.45, 7: 0.55})
    weak: dict = field(default_factory=lambda: {1: 0.35, 2: 0.45, 4: 0.55, 7: 0.65})
    immediate_fail_severity: int = 3
    consecutive_poor_limit: int | None = 2
    consecutive_weak_limit: int | None = 3
    dip_threshold: float | None = 0.4
    dip_min_word_len: int = 4
    window_size: int = 4
    window_average: float | None = 0.6
    window_base_weight: float = 1.0
    window_weight_per_char: float = 0.15
    gap_min_ms: int = 800
    gap_max_speech_ms: int | None = 500

    def __post_init__(self) -> None:
        _within("immediate_fail_severity", self.immediate_fail_severity, 1, 3)
        _within("consecutive_poor_limit", self.consecutive_poor_limit, 2, null=True)
        _within("consecutive_weak_limit", self.consecutive_weak_limit, 2, null=True)
        _within("window_size", self.window_size, 3, 15)
        _within("dip_threshold", self.dip_threshold, 0, 1, null=True)
        _within("dip_min_word_len", self.dip_min_word_len, 1)
        _within("window_average", self.window_average, 0, 1, null=True)
        _within("window_base_weight", self.window_base_weight, 0)
        _within("window_weight_per_char", self.window_weight_per_char, 0)
        _within("gap_min_ms", self.gap_min_ms, 0)
        _within("gap_max_speech_ms", self.gap_max_speech_ms, 0, null=True)
        for name in ("critical", "poor", "weak"):
            if not getattr(self, name):
                raise ValueError(f"{name} has no entry")


@dataclass(frozen=True)
class PostOptions:
    """Assembly and post-processing."""

    denoise_with_vad: bool = True
    vad_threshold: float = 0.5
    vad_min_silence_ms: int = 100
    vad_min_speech_ms: int = 250
    vad_speech_pad_ms: int = 50
    vad_fade_ms: int = 10
    max_voiced_dynamic_range_db: float | None = 20.0
    trim_segment_silence: bool = True
    silence_sentence_ms: int = 200
    silence_paragraph_ms: int = 600
    silence_fallback_ms: int = 150
    normalize_audio: bool = True
    normalize_method: str = "ebu"
    normalize_level: float = -18.0
    lead_in_ms: int | None = None
    lead_out_ms: int | None = None
    export_format: str = "mp3"
    mp3_bitrate: str = "192k"

    def __post_init__(self) -> None:
        _within("vad_threshold", self.vad_threshold, 0, 1)
        _within("vad_min_silence_ms", self.vad_min_silence_ms, 0, 5000)
        _within("vad_min_speech_ms", self.vad_min_speech_ms, 0, 1000)
        _within("vad_speech_pad_ms", self.vad_speech_pad_ms, 0, 500)
        _within("vad_fade_ms", self.vad_fade_ms, 0, 200)
        _within("max_voiced_dynamic_range_db", self.max_voiced_dynamic_range_db, 0, 60, null=True)
        for name in ("silence_sentence_ms", "silence_paragraph_ms", "silence_fallback_ms"):
            _within(name, getattr(self, name), 0, 5000)
        _within("normalize_level", self.normalize_level, -70, -5)
        _within("lead_in_ms", self.lead_in_ms, 0, 10_000, null=True)
        _within("lead_out_ms", self.lead_out_ms, 0, 10_000, null=True)
        _one_of("normalize_method", self.normalize_method, ("ebu", "peak"), "method")
        _one_of("export_format", self.export_format, ("mp3", "wav", "flac"), "export format")


@dataclass(frozen=True)
class RequestOptions:
    """One request: text options and the job grid."""

    seed: int | tuple = 0
    best_of: int = 1
    max_retries: int = 1
    return_timestamps: bool = False
    text: TextOptions = field(default_factory=TextOptions)
    validation: ValidationOptions = field(default_factory=ValidationOptions)
    alignment: AlignmentOptions = field(default_factory=AlignmentOptions)
    post: PostOptions = field(default_factory=PostOptions)

    def __post_init__(self) -> None:
        _within("best_of", self.best_of, 1, 10)
        _within("max_retries", self.max_retries, 0, 20)


def template() -> dict:
    """All options with their defaults, nested."""
    return asdict(RequestOptions())
