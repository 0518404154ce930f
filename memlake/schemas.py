"""Table schemas as DDL, shared by sources, jobs and tests."""

RAW_MESSAGES = ("agent_id string, session_id string, message_id bigint, ts timestamp, role string, "
                "blocks array<struct<type string, text string, name string, arguments map<string,string>>>")
TURNS = ("agent_id string, memory_date date, session_id string, ts timestamp, hhmm string, role string, "
         "content string, message_type string, turn_index bigint")
STATUS = ("struct<initialized boolean, initialized_at timestamp, filled boolean, filled_at timestamp, "
          "archived boolean, archived_at timestamp, trimmed boolean, trimmed_at timestamp, "
          "restored boolean, restored_at timestamp>")
TOPICS = "array<struct<name string, detail string>>"
KEY_ITEMS = "array<struct<type string, desc string>>"
PEAKS = "array<struct<turn bigint, emotion string, intensity int, context string>>"
DATED_PEAKS = "array<struct<date date, emotion string, intensity int, context string>>"
L2_DAYS = f"agent_id string, memory_date date, status {STATUS}"
L1_DAYS = (f"agent_id string, memory_date date, total_turns bigint, user_turns bigint, assistant_turns bigint, "
           f"tools_called_count bigint, memory_signal string, summary string, tags array<string>, day_mood string, "
           f"topics {TOPICS}, decisions array<string>, todos array<string>, key_items {KEY_ITEMS}, "
           f"emotional_peaks {PEAKS}, compress_hints array<bigint>, status {STATUS}")
DAY_SUMMARY = (f"memory_signal string, topics {TOPICS}, decisions array<string>, todos array<string>, "
               f"summary string, key_items {KEY_ITEMS}, tags array<string>, day_mood string, "
               f"emotional_peaks {PEAKS}, source_turns array<bigint>")
ROLLUPS = (f"agent_id string, depth string, time_key string, window_date_start date, window_date_end date, "
           f"source_weeks array<string>, mood string, summary string, tags array<string>, topics {TOPICS}, "
           f"decisions array<string>, todos array<string>, key_items {KEY_ITEMS}, "
           f"emotional_peaks {DATED_PEAKS}, no_l1_files boolean")
L0_INDEX = ("agent_id string, depth string, time_key string, summary string, tags array<string>, mood string, "
            "window_date_start string, access_count bigint")
L0_EMBEDDINGS = "agent_id string, depth string, time_key string, text_used string, embedding array<double>"
LANDMARK_COUNTS = "agent_id string, memory_date date, key_items map<string,bigint>, intensities map<int,bigint>"
DAY_MARKERS = "agent_id string, memory_date date, marker string"
SESSION_REGISTRY = "agent_id string, memory_date date, session_id string, first_seen timestamp"
SESSION_ARCHIVE = ("agent_id string, session_id string, dates array<date>, first_seen_min timestamp, "
                   "archived_files array<string>, archived_at timestamp")
