"""Keyed state over streams: intervals and orphan references as data arrives."""
