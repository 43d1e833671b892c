"""Predicates: structured search, filter trees and time windows as Columns."""
