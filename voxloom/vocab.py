"""Token-id layout shared by every sequence operator."""

from __future__ import annotations

from dataclasses import dataclass

# Codec rates and the training column names.
SAMPLE_RATE = 22050
FRAMES_PER_SECOND = 12.5
LAYERS = ("nano_layer_1", "nano_layer_2", "nano_layer_3", "nano_layer_4")
ENCODED_COLUMNS = (*LAYERS, "encoded_len", "text", "speaker")
TRAINING_COLUMNS = ("input_ids", "labels", "attention_mask", "position_ids")

# Padding per training column.
LABEL_PAD = -100
MASK_PAD = 0
POSITION_PAD = 0


@dataclass(frozen=True)
class TokenLayout:
    """One vocabulary: text ids, then control ids, then one id range per codebook.

    ``text_vocab`` and ``codebook_size`` are parameters; all other ids follow.
    """

    text_vocab: int = 64400
    codebook_size: int = 4032
    codebooks: int = 4
    start_of_text: int = 1
    end_of_text: int = 2

    @property
    def start_of_speech(self) -> int:
        return self.text_vocab + 1

    @property
    def end_of_speech(self) -> int:
        return self.text_vocab + 2

    @property
    def start_of_human(self) -> int:
        return self.text_vocab + 3

    @property
    def end_of_human(self) -> int:
        return self.text_vocab + 4

    @property
    def start_of_ai(self) -> int:
        return self.text_vocab + 5

    @property
    def end_of_ai(self) -> int:
        return self.text_vocab + 6

    @property
    def pad(self) -> int:
        return self.text_vocab + 7

    @property
    def audio_start(self) -> int:
        return self.text_vocab + 10

    def codebook_start(self, k: int) -> int:
        """First token id of codebook ``k`` (0-based)."""
        return self.audio_start + self.codebook_size * k


DEFAULT_LAYOUT = TokenLayout()
