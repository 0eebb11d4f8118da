"""Explicit schemas of every entity: nothing is inferred."""

TRADES = "ts_recv timestamp, ts_event timestamp, sequence bigint, action string, price bigint, size bigint, symbol string, instrument_id bigint, publisher_id int"
BARS = "ts_event timestamp, symbol string, instrument_id bigint, publisher_id int, open double, high double, low double, close double, volume bigint, source string"
TICK_BARS = "tf string, trading_date date, start_ns bigint, quality string, open_ticks bigint, high_ticks bigint, low_ticks bigint, close_ticks bigint"
SYMBOLOGY = "instrument_id bigint, root string"
MEDIA = "id string, category string, volume string, title string, source string, duration_sec double, duration_hms string, width int, height int, fps string"
SEGMENTS = "video string, start double, end double, text string"
MOMENTS = "video string, t double, label string, why string"
KEYFRAMES = "video string, index int, t int, hms string, file string, source string, label string, why string, narration string"
CAPTIONS = "video string, index int, t int, file string, caption string"
STAGES = "video string, stage string, status string, ts double, heartbeat double, attempts int, pid int, host string, error string, elapsed_sec double"
FRAMES = "video string, t int, dhash string, fine array<float>"
STATES = (
    "id string, video string, state_id int, t_start double, t_end double, duration_sec double, rep_t double, dhash string, recur_group int, "
    "narration_window string, split_reason string, max_fine_frac double"
)
RECORDS = (
    "id string, video string, state_id int, status string, frame_class string, ocr_text string, ocr_confidence string, ocr_text_capped boolean, "
    "chart struct<instrument:string,timeframe:string,drawn_levels:array<struct<label:string,value:string>>,annotations:array<string>>, "
    "concepts array<string>, narration_window string, attempts int"
)
LEVEL_CHECKS = (
    "id string, video string, t_start double, instrument string, label string, value_raw string, parsed double, in_range boolean, "
    "daily_ohlc_match struct<field:string,trading_date:date,price:double,delta_ticks:double>, verdict string"
)
REPAIRS = "id string, wrong string, right string, scope string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
