"""Table schemas of the catalogue."""

GUIDES = (
    "id STRING, title STRING, content STRING, format STRING, file_path STRING, game_id STRING, last_read_position BIGINT, "
    "metadata STRING, ai_analyzed_at BIGINT, created_at BIGINT, updated_at BIGINT"
)
GAMES = (
    "id STRING, title STRING, ra_game_id STRING, platform STRING, completion_percentage DOUBLE, status STRING, "
    "artwork_url STRING, metadata STRING, created_at BIGINT, updated_at BIGINT"
)
BOOKMARKS = "id STRING, guide_id STRING, position BIGINT, name STRING, page_reference STRING, is_last_read BOOLEAN, created_at BIGINT"
NOTES = "id STRING, guide_id STRING, position BIGINT, content STRING, created_at BIGINT, updated_at BIGINT"
ACHIEVEMENTS = (
    "id STRING, ra_achievement_id STRING, game_id STRING, title STRING, description STRING, points BIGINT, badge_url STRING, "
    "is_pinned BOOLEAN, is_unlocked BOOLEAN, unlock_time BIGINT, created_at BIGINT, updated_at BIGINT"
)
GUIDE_TAGS = "guide_id STRING, tag STRING"
GUIDE_PLATFORMS = "platform STRING"
TABLES = {
    "guides": GUIDES,
    "games": GAMES,
    "bookmarks": BOOKMARKS,
    "notes": NOTES,
    "achievements": ACHIEVEMENTS,
}
GUIDE_META = "platform STRING, genre STRING, author STRING, version STRING, tags ARRAY<STRING>, summary STRING, gameName STRING, aiAnalyzedAt BIGINT, aiAnalysisError STRING"
GAME_META = "external_id STRING, genre STRING, release_year INT, developer STRING, guide_count INT"

# The domains of enumerated columns.
FORMATS = ("txt", "html", "md", "pdf")
STATUSES = ("in_progress", "completed", "not_started")
