"""Behaviour analytics on Spark: sessions, funnels, rankings, user activity and live ad clicks."""
