"""Reservation and guest-conversation analytics as PySpark DataFrame operators."""
