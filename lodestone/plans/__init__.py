"""Composite plans: answers, evaluation, health, coach, routines."""
