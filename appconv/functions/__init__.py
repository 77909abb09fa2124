from appconv.functions.columns import (
    SLOT_HIGH,
    SLOT_LOW,
    VECTOR_WIDTH,
    clip_slot,
    cohort_filter,
    empty_to_na,
    in_window,
    known_ids,
    log_bin,
    mask_to_array,
    mask_to_text,
    slot_bit,
)
from appconv.functions.dates import day_list, shift_day

__all__ = [
    "SLOT_HIGH",
    "SLOT_LOW",
    "VECTOR_WIDTH",
    "clip_slot",
    "cohort_filter",
    "day_list",
    "empty_to_na",
    "in_window",
    "known_ids",
    "log_bin",
    "mask_to_array",
    "mask_to_text",
    "shift_day",
    "slot_bit",
]
