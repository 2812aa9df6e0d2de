"""Constants of the interval model. Times are whole milliseconds."""

MAX_OFFSET_MS, FAR_OFFSET_MS = 900_000, 5_400_000
SPLIT_WINDOW, SPLIT_STEP, REFINE_WINDOW, REFINE_STEP = 600_000, 100, 45_000, 25
JUMP_MS, BACK_MS = 300_000, 60_000
RATIOS = (1.0, 24 / 23.976, 23.976 / 24, 25 / 24, 24 / 25, 25 / 23.976, 23.976 / 25, 30 / 29.97, 29.97 / 30, 30 / 25, 25 / 30)
RATIO_SPAN, RATIO_NEAR, SCAN_BIN_MS = (0.94, 1.06), 0.003, 200
BIN_MS, BLOCK_PASS_MS, ONSET_PASS_MS, ONSET_WEIGHT, ONSET_SIGMA_MS, BUNCHING_MS = 40, 30_000, 8_000, 1.15, 120, 450
SPEECH, MIN_CUES, MIN_SPEECH_MS, MAX_CUE_MS, LEAD_IN_MS, MAX_CUES = 0.25, 10, 200, 10_000, 150, 100_000
SURE, SOME, AGREE_MS, MIN_AGREEING, SNAP_MS = 8.0, 6.0, 400, 3, 120
DAY_MS = 86_400_000
