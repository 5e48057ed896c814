"""Options of training, generation and adapters. All defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Lengths:
    train: int = 7680
    inference: int = 32768
    pad_to_multiple_of: int = 8
    shuffle_buffer: int = 2048


@dataclass(frozen=True)
class Training:
    """A profile; ``with_changes`` makes another one of it."""

    batch_size: int = 1
    epochs: int = 1
    learning_rate: float = 3e-4
    warmup_ratio: float = 0.1
    weight_decay: float = 0.1
    accumulation_steps: int = 1
    packing: bool = True
    max_grad_norm: float = 1.0
    seed: int = 7
    log_interval: int = 10
    eval_interval: int | None = None
    eval_batch_size: int | None = None
    eval_max_batches: int | None = None
    window_lengths: tuple[int, ...] | None = None
    window_weights: tuple[float, ...] | None = None

    def with_changes(self, **changes: object) -> Training:
        return replace(self, **changes)


PROFILES = {"text_pretraining": Training(epochs=3), "chat_sft": Training(batch_size=16), "chat_lora": Training(batch_size=10, learning_rate=6e-4)}


@dataclass(frozen=True)
class Generation:
    do_sample: bool = True
    temperature: float = 0.7
    top_k: int = 50
    top_p: float = 0.9
    max_length: int = 200
    repetition_penalty: float = 1.1
    repetition_window: int | None = 256


@dataclass(frozen=True)
class Adapter:
    rank: int = 2
    alpha: int = 4
    dropout: float = 0.05
    target_modules: tuple[str, ...] = ("q_proj", "v_proj")
