"""All checks, in inventory order."""

from checks import aggregates, joins, landed, models, scans, trends, windows

CHECKS = [
    *scans.CHECKS,
    *joins.CHECKS,
    *aggregates.CHECKS,
    *trends.CHECKS,
    *windows.CHECKS,
    *models.CHECKS,
    *landed.CHECKS,
]
