"""DataFrame operators over event, user-day, prediction and result tables."""
