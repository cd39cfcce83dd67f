"""Bands, limits and scales of the sensors (fixed values)."""

#: Hz. The three respiration bands differ on purpose.
RESP_BAND, FRAME_RESP_BAND, HEART_BAND = (0.10, 0.70), (0.10, 1.00), (0.65, 3.00)
IMU_RESP_BAND, IMU_HEART_BAND = (0.1, 0.6), (0.65, 4.0)
#: Metres, seconds.
GATE_HALF_WIDTH, RATE_WINDOW_S, MIN_TARGET_DISTANCE, BASE_STEP = 0.05, 20.0, 0.28, 0.0025
#: Seconds of a live trace's history.
HISTORY_S = 180.0
RESP_CONFIDENCE_MIN, HEART_CONFIDENCE_MIN = 4.0, 14.0
DOPPLER_HZ_PER_MPS = 70.16
#: Valid range steps up to 24; above, multiples of 24.
RANGE_STEPS = (1, 2, 3, 4, 6, 8, 12, 24)
DEFAULT_RATES = {"radar": 500.0, "imu": 100.0, "a121": 20.0}
