"""Fixed values the store's rules depend on.

FIXED VALUES — these must equal the store's own values for right results;
they are stated here in their natural order.
"""

from __future__ import annotations

# Room name -> furniture categories shown in that room.  Any other room name
# shows the category of the same name.
ROOM_CATEGORIES = {
    "Living Room": ["Sofas & Chair", "Tables & Desks", "Lightings"],
    "Bedroom": ["Beds & Mattresses", "Lightings", "Cabinets & Storage"],
    "Study": ["Tables & Desks", "Cabinets & Storage", "Lightings", "Study", "Sofas & Chair"],
    "Kitchen": ["Tables & Desks", "Cabinets & Storage"],
}

BIN_INBOUND = "Inbound"
BIN_OUTBOUND = "Outbound"

PENDING = "Pending"
SUBMITTED = "Submitted"
SHIPPED = "Shipped"
COMPLETED = "Completed"
UNFULFILLABLE = "Unfulfillable"
ORDER_STATUSES = [PENDING, SUBMITTED, SHIPPED, COMPLETED, UNFULFILLABLE]

# Allowed status changes of a shipping order: (from, to, needs at least one line).
STATUS_TRANSITIONS = [
    (PENDING, SUBMITTED, True),
    (SUBMITTED, SHIPPED, False),
    (SUBMITTED, UNFULFILLABLE, False),
    (SHIPPED, COMPLETED, False),
    (SHIPPED, UNFULFILLABLE, False),
]

# Country whose price the purchase history shows.
HISTORY_COUNTRY = 25

SALE_CURRENCY = "SGD"

# Pseudo category lifting the retail category filter.
ALL_RETAIL = "All Retail Products"

# Item TYPE text per subtype, as written on insert.
SUBTYPE_TYPE = {
    "FurnitureEntity": "Furniture",
    "RetailProductEntity": "Retail Product",
    "RawMaterialEntity": "Raw Material",
}

# Order line quantity bounds.
MIN_LINE_QTY = 1
MAX_LINE_QTY = 9999

# Staff menu areas -> role ids allowed to see them.
AREA_ROLES = {
    "Account Management": [1, 2, 11],
    "Purchasing": [1, 2, 3, 4, 7, 8, 11],
    "Supplier Management": [1, 2, 7, 11],
    "Logistics": [1, 2, 3, 4, 8, 11],
    "Manufacturing Warehouse": [1, 2, 3, 8, 11],
    "Store Inventory": [1, 2, 3, 4, 11],
    "Loyalty & Rewards": [1, 5, 11],
    "Loyalty Card": [1, 2, 4, 5, 10, 11],
    "Customer Service": [1, 2, 4, 11],
    "Promotional Sales": [1, 2, 4, 5, 11],
    "Facility Management": [1, 11],
    "Item Management": [1, 6, 11],
    "Restaurant Management": [1, 6, 11],
}

# Image paths.
DEFAULT_PRODUCT_IMAGE = "/img/products/default.jpg"
PRODUCT_IMAGE_DIR = "/img/products/"
PROMOTION_IMAGE_DIR = "/img/promotions/"
IMAGE_PREFIX = "/img/"

# Grid page lengths (-1 = all rows).
PAGE_LENGTHS = [10, 25, 50, 100]
DEFAULT_PAGE_LENGTH = 10
