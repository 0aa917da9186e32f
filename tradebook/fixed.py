"""Texts, labels, limits and names that results must carry exactly."""

# --- fixed values: names under which the scalar functions can be called from SQL
SQL_ORDER_TOTAL = "fn_calculate_order_total"
SQL_DELIVERY_DELAY = "fn_calculate_delivery_delay"
SQL_REVIEW_SENTIMENT = "fn_get_review_sentiment"

# --- fixed values: temp views filled by the metric preparations
VIEW_CATEGORY_REVENUE = "tmp_category_revenue_summary"
VIEW_PAYMENT_METRICS = "tmp_payment_metrics_summary"
VIEW_LOCATION_REVENUE = "tmp_location_revenue_summary"
VIEW_SELLER_REVENUE = "tmp_seller_revenue_summary"
VIEW_SHIPPING_DELAYS = "tmp_shipping_delays"
VIEW_SENTIMENT_METRICS = "tmp_sentiment_metrics_summary"

# --- fixed values: review sentiment names
POSITIVE = "Positive"
NEUTRAL = "Neutral"
NEGATIVE = "Negative"
UNKNOWN = "Unknown"

# --- fixed values: order statuses
STATUS_DELIVERED = "delivered"
STATUS_CREATED = "created"
STATUS_DEFAULT = "invoiced"
UPDATE_STATUSES = ("delivered", "shipped", "cancelled", "unavailable", "invoiced")

# --- fixed values: limits
ID_BYTES = 32
STATE_BYTES = 2
LATITUDE_LIMIT = 90
LONGITUDE_LIMIT = 180
DEFAULT_DELIVERY_DAYS = 7
FIND_ORDERS_LIMIT = 100

# --- fixed values: reasons given by the request operators
SELLER_ZIP_MISSING = "Input Validation Failed: Zip Code prefix cannot be null or empty."
SELLER_CITY_MISSING = "Input Validation Failed: City name cannot be null or empty."
SELLER_STATE_INVALID = "Input Validation Failed: State must be a valid 2-character abbreviation (e.g., SP)."
SELLER_SEARCH_BLANK = "Validation Error: Search fields cannot be empty strings. Pass NULL for open criteria."
SELLER_SEARCH_STATE = "Validation Error: State filter criteria must be exactly 2 characters."
SELLER_ID_INVALID = "Validation Error: Invalid Seller ID. Must be a non-null 32-character hex string."
SELLER_PATCH_BLANK = "Validation Error: New modification properties cannot be blank text blocks."
SELLER_PATCH_STATE = "Validation Error: Target modification state code must be exactly 2 characters."
SELLER_DELETE_ID = "Validation Error: Deletion halted. Target Seller ID must be exactly 32 characters."
ORDER_CUSTOMER_ID = "Validation Error: Customer ID must be a non-null 32-character hex hash."
ORDER_ESTIMATE = "Validation Error: Estimated delivery date cannot be empty or in the past."
ORDER_CUSTOMER_UNKNOWN = "Integrity Error: Provided Customer ID does not exist in the database."
ORDER_SEARCH_BLANK = "Validation Error: Filters cannot be empty text. Pass NULL for open criteria."
ORDER_PATCH_ID = "Validation Error: Targeted Order ID must be exactly 32 characters."
ORDER_DELETE_ID = "Validation Error: Target deletion hash length is invalid."

# --- fixed values: statuses given by the delete operators; %s stands for the id
SELLER_REMOVED = "SUCCESS: Seller ID %s successfully removed."
ORDER_REMOVED = "SUCCESS: Order ID %s and all its sub-records purged cleanly."

# --- fixed values: reasons given by the row rules
CUSTOMER_UNIQUE_ID_NULL = "Update to unique ID cannot be empty"
LOCATION_PARTIAL = "Update to geolocation fields cannot be partially empty"
ITEM_NEGATIVE = "Cannot set negative value for freight value and price"
PAYMENT_NEGATIVE = "Cannot put negative values in installment and value"
ORDER_DATE_TO_NULL = "Cannot set date to null"
ORDER_STATUS_UNKNOWN = "Incorrect status message"
GEO_FIELD_NULL = "1 or more fields cannot be empty"
LATITUDE_RANGE = "Latitude out of range: value must be within -90 and 90 degrees"
LONGITUDE_RANGE = "Longitude out of range: value must be within -180 and 180 degrees"

# --- fixed values: audit texts; {old.x} and {new.x} stand for column values
AUDIT_INSERT = {
    "customers": "Added customer with id: {new.customer_id}",
    "sellers": "Added new seller: {new.seller_id}",
    "order_items": "Added new order id {new.order_id}with item id: {new.order_item_id}",
    "order_payments": "Added order payment: {new.order_id}",
    "products": "Added product id: {new.product_id}",
    "orders": "Added order: {new.order_id}",
    "geolocation": "New location added at {new.geolocation_city} with LAT/LON {new.geolocation_lat}/{new.geolocation_lng}",
    "order_reviews": "Added order review: {new.order_id}",
    "product_category_name_translation": "Added translation name: {new.product_category_name}",
}
AUDIT_DELETE = {
    "customers": "Deleted customer with the id: {old.customer_id}",
    "sellers": "Deleted seller: {old.seller_id}",
    "order_items": "Deleted order id {old.order_id} with item id: {old.order_item_id}",
    "order_payments": "Deleted order payment: {old.order_id}",
    "products": "Deleted product id: {old.product_id}",
    "orders": "Deleted order: {old.order_id}",
    "geolocation": "Deleted location at {old.geolocation_city} with LAT/LON of {old.geolocation_lat}/{old.geolocation_lng}",
    "order_reviews": "Deleted order review: {old.order_id}",
    "product_category_name_translation": "Deleted translation for {old.product_category_name}",
}
# Leading parts of an update text, joined with "," to the messages below.
AUDIT_UPDATE_HEAD = {
    "customers": ("Updated on ID ", "{old.customer_id}", ": "),
    "sellers": (),
    "order_items": ("Updated order item on id {old.order_item_id}",),
    "order_payments": ("Payment updated on id ", "{old.order_id}"),
    "products": ("Updated on product id {old.product_id}",),
    "orders": ("Updated orders on id ", "{old.order_id}"),
    "geolocation": (),
    "order_reviews": ("Updated review on id {old.review_id}",),
    "product_category_name_translation": ("Updated translation for {new.product_category_name}",),
}
# (columns of which one must differ, text) in the order in which the texts are joined.
AUDIT_UPDATE_MESSAGES = {
    "customers": (
        (("customer_unique_id",), "Updated unique id: {old.customer_id}"),
        (
            ("customer_zip_code_prefix", "customer_city", "customer_state"),
            "Updated location: {new.customer_zip_code_prefix},{new.customer_city},{new.customer_state}",
        ),
    ),
    "sellers": (
        (
            ("seller_zip_code_prefix", "seller_city", "seller_state"),
            "Updated location for id {old.seller_id}: "
            "{new.seller_zip_code_prefix},{new.seller_city},{new.seller_state}",
        ),
    ),
    "order_items": (
        (("product_id",), "Product id: {new.product_id}"),
        (("seller_id",), "Seller id: {new.seller_id}"),
        (("shipping_limit_date",), "Due Date: {new.shipping_limit_date}"),
        (("price",), "Price: {new.price}"),
        (("freight_value",), "Freight value: {new.freight_value}"),
    ),
    "order_payments": (
        (("payment_installments",), "New installment: {new.payment_installments}"),
        (("payment_value",), "New value: {new.payment_value}"),
    ),
    "products": (
        (("product_category_name",), "New category: {new.product_category_name}"),
        (("product_name_length",), "New name length: {new.product_name_length}"),
        (("product_description_length",), "New desc length: {new.product_description_length}"),
        (("product_photos_qty",), "New photo quantity: {new.product_photos_qty}"),
        (("product_weight_g",), "New weight: {new.product_weight_g}"),
        (("product_length_cm",), "New length: {new.product_length_cm}"),
        (("product_height_cm",), "New height: {new.product_height_cm}"),
        (("product_width_cm",), "New width: {new.product_width_cm}"),
    ),
    "orders": (
        (("order_status",), "New status: {new.order_status}"),
        (("order_approved_at",), "New status: {new.order_approved_at}"),
        (("order_delivered_carrier_date",), "New status: {new.order_delivered_carrier_date}"),
        (("order_delivered_customer_date",), "New status: {new.order_delivered_customer_date}"),
    ),
    "geolocation": (
        (("geolocation_zip_code_prefix",), "ZIP Code updated: {new.geolocation_zip_code_prefix}"),
        (("geolocation_lat",), "Latitude updated: {new.geolocation_lat}"),
        (("geolocation_lng",), "Longitute updated: {new.geolocation_lng}"),
        (("geolocation_city",), "City updated: {new.geolocation_city}"),
        (("geolocation_state",), "State updated: {new.geolocation_state}"),
    ),
    "order_reviews": (
        (("review_score",), "New score:{new.review_score}"),
        (("review_comment_title",), "New title:{new.review_comment_title}"),
        (("review_comment_message",), "New message:{new.review_comment_message}"),
        (("review_creation_date",), "New creation date:{new.review_creation_date}"),
        (("review_answer_timestamp",), "New answer timestamp:{new.review_answer_timestamp}"),
    ),
    "product_category_name_translation": (),
}
