"""Readers, writers and derived panels."""
