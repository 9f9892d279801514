"""Seed rows of the operational tables and the sensor readings, and the results they give."""

from __future__ import annotations

from datetime import datetime

# Customers (id, name, email, region, tier, signup date), batch 1 then batch 2.
CUSTOMERS_1 = [
    (1, "Alice Johnson", "alice@example.com", "AMER", "ENTERPRISE", "2024-01-15"),
    (2, "Bob Smith", "bob@example.com", "EMEA", "PREMIUM", "2024-02-20"),
    (3, "Carol White", "carol@example.com", "APAC", "STANDARD", "2024-03-10"),
    (4, "David Kim", "david@example.com", "AMER", "PREMIUM", "2024-04-05"),
    (5, "Emma Garcia", "emma@example.com", "EMEA", "ENTERPRISE", "2024-05-22"),
]
CUSTOMERS_2 = [
    (6, "Frank Lee", "frank@example.com", "APAC", "PREMIUM", "2024-07-01"),
    (7, "Grace Chen", "grace@example.com", "AMER", "STANDARD", "2024-07-15"),
    (8, "Hideo Tanaka", "hideo@example.com", "APAC", "ENTERPRISE", "2024-08-03"),
    (9, "Irina Petrov", "irina@example.com", "EMEA", "PREMIUM", "2024-08-20"),
    (10, "James Okafor", "james@example.com", "AMER", "ENTERPRISE", "2024-09-10"),
]

# Products (id, name, category, sub-category, list price, active).
PRODUCTS_1 = [
    (101, "Widget Pro", "Hardware", "Connectors", 29.99, True),
    (102, "DataPipe SDK", "Software", "Integration", 299.00, True),
    (103, "CloudSync", "Software", "Storage", 149.00, True),
    (104, "EdgeSensor Kit", "Hardware", "IoT", 89.99, True),
    (105, "Legacy Adapter", "Hardware", "Connectors", 9.99, False),
]
PRODUCTS_2 = [
    (106, "SecureVault", "Software", "Security", 499.00, True),
    (107, "FlowRouter", "Hardware", "Networking", 199.99, True),
    (108, "DataLens Pro", "Software", "Analytics", 349.00, True),
    (109, "EdgeCompute X", "Hardware", "IoT", 299.99, True),
    (110, "Legacy Bridge", "Software", "Integration", 49.99, False),
]

# Orders (id, customer, product, quantity, unit price, date, status).
ORDERS_1 = [
    (1001, 1, 101, 2, 29.99, "2024-06-01", "DELIVERED"),
    (1002, 2, 102, 1, 299.00, "2024-06-03", "DELIVERED"),
    (1003, 3, 103, 3, 149.00, "2024-06-05", "SHIPPED"),
    (1004, 1, 104, 1, 89.99, "2024-06-07", "DELIVERED"),
    (1005, 4, 101, 5, 29.99, "2024-06-10", "PENDING"),
    (1006, 5, 102, 2, 299.00, "2024-06-12", "SHIPPED"),
    (1007, 2, 105, 10, 9.99, "2024-06-15", "DELIVERED"),
    (1008, 3, 101, 1, 29.99, "2024-06-18", "CANCELLED"),
    (1009, 4, 103, 2, 149.00, "2024-06-20", "DELIVERED"),
    (1010, 5, 104, 3, 89.99, "2024-06-22", "PENDING"),
]
ORDERS_2 = [
    (1011, 6, 106, 1, 499.00, "2024-07-05", "DELIVERED"),
    (1012, 7, 107, 2, 199.99, "2024-07-08", "DELIVERED"),
    (1013, 8, 108, 1, 349.00, "2024-07-12", "SHIPPED"),
    (1014, 9, 109, 3, 299.99, "2024-07-20", "DELIVERED"),
    (1015, 10, 101, 4, 29.99, "2024-07-25", "PENDING"),
    (1016, 6, 103, 2, 149.00, "2024-08-01", "DELIVERED"),
    (1017, 7, 106, 1, 499.00, "2024-08-05", "SHIPPED"),
    (1018, 8, 104, 5, 89.99, "2024-08-10", "DELIVERED"),
    (1019, 9, 102, 1, 299.00, "2024-08-15", "CANCELLED"),
    (1020, 10, 108, 2, 349.00, "2024-08-22", "DELIVERED"),
]

# Events (id, customer, type, session, payload, date, region).
EVENTS_1 = [
    (9001, 1, "page_view", "sess-aaa", '{"page":"/home"}', "2024-06-01", "AMER"),
    (9002, 2, "add_to_cart", "sess-bbb", '{"product_id":102}', "2024-06-01", "EMEA"),
    (9003, 1, "purchase", "sess-aaa", '{"order_id":1001}', "2024-06-01", "AMER"),
    (9004, 3, "page_view", "sess-ccc", '{"page":"/products"}', "2024-06-02", "APAC"),
    (9005, 4, "add_to_cart", "sess-ddd", '{"product_id":101}', "2024-06-02", "AMER"),
    (9006, 5, "purchase", "sess-eee", '{"order_id":1006}', "2024-06-12", "EMEA"),
    (9007, 3, "refund", "sess-fff", '{"order_id":1008}', "2024-06-18", "APAC"),
]
EVENTS_2 = [
    (9008, 6, "page_view", "sess-ggg", '{"page":"/pricing"}', "2024-07-01", "APAC"),
    (9009, 7, "add_to_cart", "sess-hhh", '{"product_id":107}', "2024-07-08", "AMER"),
    (9010, 8, "purchase", "sess-iii", '{"order_id":1013}', "2024-07-12", "APAC"),
    (9011, 9, "page_view", "sess-jjj", '{"page":"/products"}', "2024-07-20", "EMEA"),
    (9012, 10, "add_to_cart", "sess-kkk", '{"product_id":101}', "2024-07-25", "AMER"),
    (9013, 6, "purchase", "sess-lll", '{"order_id":1016}', "2024-08-01", "APAC"),
    (9014, 7, "refund", "sess-mmm", '{"order_id":1012}', "2024-08-05", "AMER"),
    (9015, 8, "purchase", "sess-nnn", '{"order_id":1018}', "2024-08-10", "APAC"),
]

BATCH_1 = {"customers": CUSTOMERS_1, "products": PRODUCTS_1, "orders": ORDERS_1, "raw_events": EVENTS_1}
BATCH_2 = {"customers": CUSTOMERS_2, "products": PRODUCTS_2, "orders": ORDERS_2, "raw_events": EVENTS_2}
BOTH = {name: BATCH_1[name] + BATCH_2[name] for name in BATCH_1}

# Readings (sensor, location, metric, value, minute after 08:00), expected band.
_READINGS = [
    (1, "warehouse-a", "temperature", 22.5, 0, "B"),
    (2, "warehouse-a", "humidity", 55.3, 0, "C"),
    (3, "warehouse-b", "temperature", 19.8, 5, "A"),
    (4, "warehouse-b", "humidity", 62.1, 5, "C"),
    (5, "server-room", "temperature", 18.2, 10, "A"),
    (6, "server-room", "humidity", 40.0, 10, "B"),
    (7, "warehouse-a", "temperature", 23.1, 15, "B"),
    (8, "warehouse-b", "temperature", 20.4, 15, "B"),
    (9, "server-room", "temperature", 17.9, 20, "A"),
    (10, "server-room", "humidity", 41.5, 20, "B"),
]
READINGS = [(s, loc, m, v, datetime(2024, 1, 15, 8, minute)) for s, loc, m, v, minute, _ in _READINGS]
BANDS = {row[0]: row[5] for row in _READINGS}

# Expected results after both batches.
REGIONAL_SUMMARY = [
    ("AMER", "ENTERPRISE", 2, "2024-01-15", "2024-09-10"),
    ("AMER", "PREMIUM", 1, "2024-04-05", "2024-04-05"),
    ("AMER", "STANDARD", 1, "2024-07-15", "2024-07-15"),
    ("APAC", "ENTERPRISE", 1, "2024-08-03", "2024-08-03"),
    ("APAC", "PREMIUM", 1, "2024-07-01", "2024-07-01"),
    ("APAC", "STANDARD", 1, "2024-03-10", "2024-03-10"),
    ("EMEA", "ENTERPRISE", 1, "2024-05-22", "2024-05-22"),
    ("EMEA", "PREMIUM", 2, "2024-02-20", "2024-08-20"),
]
PRODUCT_REVENUE = [
    ("CloudSync", "Software", "Storage", 3, 7, 1043.0),
    ("DataLens Pro", "Software", "Analytics", 2, 3, 1047.0),
    ("DataPipe SDK", "Software", "Integration", 2, 3, 897.0),
    ("EdgeCompute X", "Hardware", "IoT", 1, 3, 899.97),
    ("EdgeSensor Kit", "Hardware", "IoT", 3, 9, 809.91),
    ("FlowRouter", "Hardware", "Networking", 1, 2, 399.98),
    ("Legacy Adapter", "Hardware", "Connectors", 1, 10, 99.9),
    ("SecureVault", "Software", "Security", 2, 2, 998.0),
    ("Widget Pro", "Hardware", "Connectors", 3, 11, 329.89),
]
# customer: (orders, value, last date)
CUSTOMER_LTV = {
    1: (2, 149.97, "2024-06-07"),
    2: (2, 398.9, "2024-06-15"),
    3: (1, 447.0, "2024-06-05"),
    4: (1, 298.0, "2024-06-20"),
    5: (1, 598.0, "2024-06-12"),
    6: (2, 797.0, "2024-08-01"),
    7: (2, 898.98, "2024-08-05"),
    8: (2, 798.95, "2024-08-10"),
    9: (1, 899.97, "2024-07-20"),
    10: (1, 698.0, "2024-08-22"),
}
TOP_CUSTOMERS = ["Irina Petrov", "Grace Chen", "Hideo Tanaka", "Frank Lee", "James Okafor"]
EVENT_FUNNEL = [
    ("AMER", "add_to_cart", 3, 3),
    ("AMER", "page_view", 1, 1),
    ("AMER", "purchase", 1, 1),
    ("AMER", "refund", 1, 1),
    ("APAC", "page_view", 2, 2),
    ("APAC", "purchase", 3, 2),
    ("APAC", "refund", 1, 1),
    ("EMEA", "add_to_cart", 1, 1),
    ("EMEA", "page_view", 1, 1),
    ("EMEA", "purchase", 1, 1),
]
