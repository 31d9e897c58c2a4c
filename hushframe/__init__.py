"""Column-safe exports of business tables, event logs and inventories on Spark."""
