"""Words and labels the classifiers and item processors must match exactly."""

# --- fixed values: classifier words, link markers, platform and app labels ---
APP_REVIEW_TITLE_WORDS = ["feedback", "review", "rate"]
APP_LINK_MARKERS = ["https://", "app"]
JOB_DETAIL_MARKER = "jobs_details"
DOCUMENT_MARKER = "document"
AMAZON_MARKER = "amazon"
SHORT_LINK_MARKERS = ["goo", "amzn"]
SHORT_LINK_BASE = "https://www.goo.gl/"
GOOGLE_MARKER = "google"
PLATFORM_GOOGLE = "Google Play"
PLATFORM_APPLE = "App store"
MAC_KIND = "mac-software"
LABEL_PAID = "paid-app"
LABEL_UNKNOWN = "unknown-app"
APP_TYPES = ["iPhone Apps", "iPad Apps", "Mac Apps", "App Bundles"]
DEFAULT_APP_TYPE = "App Bundles"
# --- end of fixed values ---
