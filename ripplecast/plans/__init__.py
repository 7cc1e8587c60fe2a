"""End-to-end stages: process, analyse, predict."""
