"""concordat.operators"""
