"""Readers and writers for posts, users, follow edges and API pages."""
